"""Nearest neighbours against all distances."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinfold.llm.ann import VantageTree, nearest_neighbours
from twinfold.llm.queries import op1_vantage_trees


def brute(ids, vectors, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/embeddings.parquet")
    want = brute(t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float))
    got = {}
    for r in op1_vantage_trees(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = {q: dict(zip(*map(list, zip(*x, strict=True)), strict=True)) for q, x in want.items()}
    assert all(abs(exact[q][i] - s) < 1e-12 for q, x in got.items() for i, s in x if i in exact[q])


@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_factor_one_is_exact(data):
    """Small integer coordinates, so that ties and copies abound."""
    n, d = data.draw(st.integers(1, 60)), data.draw(st.integers(1, 3))
    seed = data.draw(st.integers(0, 10**6))
    rng = np.random.default_rng(seed)
    points = rng.integers(-2, 3, (n, d)).astype(float)
    queries = rng.integers(-2, 3, (5, d)).astype(float)
    k = data.draw(st.integers(1, 8))
    row, point, _ = VantageTree(points, leaf=3).search(queries, k, 1.0)
    for q in range(5):
        distance = ((points - queries[q]) ** 2).sum(axis=1)
        last = np.sort(distance)[min(k, n) - 1]
        assert set(np.flatnonzero(distance <= last)) <= set(point[row == q])


@pytest.mark.parametrize("shards", [1, 7])
def test_copies_and_ties(spark, shards):
    rng = np.random.default_rng(6)
    vectors = rng.integers(1, 4, (700, 2)).astype(float)
    ids = np.arange(700)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(ids, vectors)
    got = {}
    out = nearest_neighbours(frame, factor=1.0, shard_rows=700 // shards + 1, block_rows=3, leaf=4)
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 3.0]), (None, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (100, [None, 1.0]), (300, [inf, 1.0]), (200, [1.0, 2.0, 3.0]), (6, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, RANK string")
    got = [tuple(r) for r in nearest_neighbours(frame).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 1.0)]
    twice = nearest_neighbours(frame.union(frame)).where("query_id = 0").count()
    assert twice == 2 * 5
    assert nearest_neighbours(frame.where("false")).count() == 0


def made_vectors(kind):
    """2,000 rows each: even in all directions, in clusters, on a curved surface, and the given table."""
    rng = np.random.default_rng(12)
    n, d = 2000, 64
    if kind == "unit":
        v = rng.normal(size=(n, d))
        return v / np.linalg.norm(v, axis=1)[:, None]
    if kind == "clusters":
        return rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, d))
    if kind == "surface":
        return np.tanh(rng.normal(size=(n, 3)) @ rng.normal(size=(3, d)))
    return np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), float)


@pytest.mark.parametrize("kind, most", [("unit", 1.0), ("clusters", 0.35), ("surface", 0.15), ("table", 1.0)])
def test_recall_and_pruning_of_deep_trees(kind, most):
    """Trees of several levels at both factors, and the share of distances computed."""
    points = made_vectors(kind)
    queries = points[::100]
    near = np.argsort(((points - queries[:, None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :10]
    recall, share = {}, {}
    for factor in (1.0, 2.0):
        tree = VantageTree(points)
        row, point, _ = tree.search(queries, 10, factor)
        assert tree.depth >= 5
        hits = sum(len(set(point[row == q]) & set(near[q])) for q in range(len(queries)))
        recall[factor], share[factor] = hits / near.size, tree.visited / (len(points) * len(queries))
    assert recall[1.0] == 1.0 and recall[2.0] >= 0.9
    assert share[2.0] <= share[1.0] and share[2.0] <= most


def test_a_far_point_makes_no_candidates():
    points = np.concatenate([made_vectors("unit"), np.full((1, 64), 1e6)])
    row, point, _ = VantageTree(points).search(points[:40], 11, 2.0)
    assert len(row) < 40 * 12
    near = np.argsort(((points - points[:40, None]) ** 2).sum(axis=2), axis=1)[:, :11]
    assert all(set(near[q]) <= set(point[row == q]) for q in range(40))

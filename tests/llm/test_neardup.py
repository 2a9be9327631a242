"""Near-duplicates against all pairs, and components against a union of sets."""

import random

import pyarrow.parquet as pq
import pytest
from numpy import add

from twinfold.llm import neardup
from twinfold.llm.components import connected_components
from twinfold.llm.queries import op10_minhash_neardup


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs, percent=85):
    """Rows (id, size, component, kept) by comparing all pairs of distinct sets."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by_set = {}
    for i, s in sets.items():
        if s:
            by_set.setdefault(s, []).append(i)
    distinct = list(by_set)
    for ids in by_set.values():
        for i in ids[1:]:
            up[max(root(i), root(ids[0]))] = min(root(i), root(ids[0]))
    for a in range(len(distinct)):
        for b in range(a):
            both = len(distinct[a] & distinct[b])
            if 100 * both >= percent * (len(distinct[a]) + len(distinct[b]) - both):
                x, y = root(by_set[distinct[a]][0]), root(by_set[distinct[b]][0])
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


def test_query(spark, small):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    want = brute(docs)
    assert sorted(map(tuple, op10_minhash_neardup(spark, small).collect())) == want
    assert any(not kept for *_, kept in want)


def made(seed):
    """Groups of copies with edits, from one word to long, and many exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 40, 200, 400]))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(rng.choice([" ", "\n", "\t "]).join(copy))
    docs += ["Same words " * 9] * 50 + [None, "", " \n "]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_made_groups(spark, seed):
    docs = made(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got, want = sorted(map(tuple, neardup.near_duplicates(frame).collect())), brute(docs)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert got == want


def test_blocks_lose_no_link(spark, monkeypatch):
    docs = [(i, t) for i, t in made(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, neardup.near_duplicates(frame).collect()))
    for bucket, group in ((2, 300), (4096, 60)):
        monkeypatch.setattr(neardup, "BUCKET_BLOCK", bucket)
        monkeypatch.setattr(neardup, "GROUP_BLOCK", group)
        monkeypatch.setattr(neardup, "MEMBER_WEIGHT", 10)
        assert sorted(map(tuple, neardup.near_duplicates(frame).collect())) == whole


def test_chain_across_blocks(spark, monkeypatch):
    """Each text is linked with the next one only, so blocks leave most apart."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r[2] for r in brute(docs)} == {0}
    monkeypatch.setattr(neardup, "GROUP_BLOCK", 600)
    assert {r.component_id for r in neardup.near_duplicates(frame).collect()} == {0}


def boilerplate(n, own=30, common=90):
    """Texts that share three quarters of their shingles, and a copy of every tenth."""
    frame = [f"c{i}" for i in range(common)]
    docs = [" ".join([*[f"o{i}x{j}" for j in range(own)], *frame]) for i in range(n)]
    return list(enumerate(docs + [d + " end" for d in docs[::10]]))


@pytest.mark.parametrize("percent", [80, 85])
def test_boilerplate_groups_fall_apart(spark, monkeypatch, percent):
    docs = boilerplate(60)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, percent)
    assert len({r[2] for r in want}) == 60
    assert sorted(map(tuple, neardup.near_duplicates(frame, percent).collect())) == want
    monkeypatch.setattr(neardup, "GROUP_BLOCK", 20_000)  # five members
    assert sorted(map(tuple, neardup.near_duplicates(frame, percent).collect())) == want


def test_sets_that_share_only_what_all_share_are_not_compared(monkeypatch):
    import numpy as np

    sets = [neardup.shingle_set(neardup.split_words(t.encode())) for _, t in boilerplate(100)]
    linked = neardup._by_set(80)(None, [s.tobytes() for s in sets])
    compared = []
    monkeypatch.setattr(neardup.np, "add", type("add", (), {"reduceat": lambda f, b, dtype: compared.append(len(b)) or np.ufunc.reduceat(add, f, b, dtype=dtype)}))
    everyone = np.arange(len(sets))
    links = sum(int(linked(x, everyone).sum()) for x in everyone)
    assert links == 110 + 2 * 10 and sum(compared) < 3 * links


def test_filter_of_ids(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    bits = neardup._filter_bits(spark.range(2_000).select(F.xxhash64("id").alias("h")))
    found = neardup._in_filter(rows, bits)
    assert found[:2000].all() and found[2000:].mean() < 0.05 and len(bits) * 64 == 32_768
    none = neardup._filter_bits(spark.range(0).select(F.xxhash64("id").alias("h")))
    assert not neardup._in_filter(rows, none).any() and isinstance(none, np.ndarray)


def test_sketch_estimates_high_similarities():
    import numpy as np

    rng = np.random.default_rng(4)
    for same in (0.85, 0.9, 0.97, 1.0):
        errors = []
        for _ in range(60):
            n = 600
            keep = round(n * 2 * same / (1 + same))
            pool = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:keep], pool[n : 2 * n - keep]]))
            x, y = (np.frombuffer(neardup.signature(s)[1], np.uint64) for s in (a, b))
            differing = np.bitwise_count(x ^ y).sum(dtype=np.int64)
            errors.append(float(neardup.sketch_similarity(np.array([differing]))[0]) - same)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_odd_documents(spark, odd_documents):
    rows = sorted(map(tuple, neardup.near_duplicates(odd_documents).collect()), key=str)
    assert len(rows) == 8
    assert [(r[2], r[3]) for r in rows if r[0] == 4] == [(4, True)] * 2
    assert [(r[2], r[3]) for r in rows if r[0] is None] == [(4, False)]
    assert {r[0]: r[1] for r in rows if r[0] in (1, 2, 5)} == {1: 0, 2: 0, 5: 0}
    assert neardup.near_duplicates(odd_documents.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_what_the_result_reads_stays(spark):
    from twinfold.sources import staging

    before = set(staging._staged)
    out = neardup.near_duplicates(spark.createDataFrame(made(4)[:80], "doc_id long, text string"))
    assert out.count() == 80 and len(set(staging._staged) - before) == 2
    out = neardup.drop_near_duplicates(spark.createDataFrame(made(4)[:80], "doc_id long, text string"))
    assert out.count() < 80 and len(set(staging._staged) - before) == 3

"""Nearest neighbours from vantage-point trees, one tree for each shard.

A node of a tree splits its points by their distance from a vantage point and
keeps the range of distances on either side. By the triangle inequality a side
cannot hold anything nearer than the gap between a query's distance and that
range; the gap is multiplied by a factor before it is held against the best
distances so far. A factor of one is exact search, a larger one prunes more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.frames import pick, stage


class VantageTree:
    """A vantage-point tree over the rows of a matrix, for batches of queries."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.points, self.leaf = points, leaf
        self.square = np.einsum("ij,ij->i", points, points)
        #: What rounding may add to a squared distance, for one unit of the squared norms.
        self.rounding = 2e-15 * (points.shape[1] + 32)
        self.visited = self.depth = 0
        self.root = self._node(np.arange(len(points)), 0)

    def _node(self, at: np.ndarray, depth: int):
        self.depth = max(self.depth, depth)
        if len(at) <= self.leaf:
            return at
        # the vantage point: of a few points the one farthest from their middle
        few = at[:: max(1, len(at) // 64)]
        middle = self.points[few].mean(axis=0)
        vantage = few[int(((self.points[few] - middle) ** 2).sum(axis=1).argmax())]
        d = np.sqrt(((self.points[at] - self.points[vantage]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        sides = []
        for part in (order[:half], order[half:]):
            sides.append((float(d[part[0]]), float(d[part[-1]]), self._node(np.sort(at[part]), depth + 1)))
        return vantage, sides

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates ``(query, point, squared)``: the ``k`` nearest that were
        found for each query, and all that rounding cannot tell from the last
        of them. Rounding is bounded for each pair by its own norms, so that a
        far point makes no other one a candidate."""
        square = np.einsum("ij,ij->i", queries, queries)
        best = np.full((len(queries), k), np.inf)  # upper bounds of the nearest squared distances
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node, rows):
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                norms = square[rows][:, None] + self.square[node]
                d = np.maximum(norms - 2.0 * (queries[rows] @ self.points[node].T), 0.0)
                self.visited += d.size
                norms *= self.rounding
                both = np.concatenate([best[rows], d + norms], axis=1)
                both.partition(k - 1, axis=1)
                best[rows] = both[:, :k]
                r, c = np.nonzero(d - norms <= best[rows].max(axis=1)[:, None])
                found.append((rows[r], node[c], (d - norms)[r, c]))
                return
            vantage, sides = node
            d = np.sqrt(((queries[rows] - self.points[vantage]) ** 2).sum(axis=1))
            gap = np.stack([np.maximum(lo - d, d - hi) - 1e-12 * (d + hi) for lo, hi, _ in sides])
            first = gap.argmin(axis=0)
            for turn in (0, 1):
                for side in (0, 1):
                    mine = (first == side) == (turn == 0)
                    # best may have shrunk since, so it is looked up only now
                    open_ = factor * gap[side] <= np.sqrt(best[rows].max(axis=1))
                    visit(sides[side][2], rows[mine & open_])

        if len(self.points):
            for at in range(0, len(queries), 4096):
                visit(self.root, np.arange(at, min(at + 4096, len(queries))))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, point, least = (np.concatenate([f[i] for f in found]) for i in range(3))
        near = least <= best.max(axis=1)[row]
        return row[near], point[near], least[near]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest_in_cell(table: pa.Table, k: int, factor: float, leaf: int) -> pa.Table:
    """The ``k`` nearest of one shard's rows for every query of one block."""
    asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
    queries, rows = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    out = {"query": [], "query_id": [], "vec_id": [], "tag": [], "score": []}
    if len(queries) and len(rows):
        q, p = _matrix(queries["embedding"]), _matrix(rows["embedding"])
        ids, tags = (rows[c].to_numpy().astype(np.int64) for c in ("vec_id", "tag"))
        order = np.lexsort((tags, ids))
        p, ids, tags = p[order], ids[order], tags[order]
        # equal vectors are one point; of its rows the k + 1 smallest ids can count
        key = np.ascontiguousarray(p + 0.0).view(np.dtype((np.void, p.shape[1] * 8)))[:, 0]
        _, first, copy = np.unique(key, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))
        copy, first = rank[copy], np.sort(first)
        by_point = np.argsort(copy, kind="stable")
        begin = np.searchsorted(copy[by_point], np.arange(len(first)))
        count = np.minimum(np.diff(np.append(begin, len(p))), k + 1)
        tree = VantageTree(p[first], leaf)
        row, point, _ = tree.search(q, k + 1, factor)
        n = count[point]
        row, point = np.repeat(row, n), np.repeat(point, n)
        member = by_point[begin[point] + np.arange(len(point)) - np.repeat(np.cumsum(n) - n, n)]
        own = queries["tag"].to_numpy().astype(np.int64)
        keep = tags[member] != own[row]
        row, member = row[keep], member[keep]
        score = np.concatenate(
            [np.sqrt(((q[row[i : i + 65536]] - p[member[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(row), 65536)]
            or [np.zeros(0)]
        )
        order = np.lexsort((tags[member], ids[member], score, row))
        row, member, score = row[order], member[order], score[order]
        start = np.searchsorted(row, row)
        top = np.arange(len(row)) - start < k
        row, member, score = row[top], member[top], score[top]
        asked = queries["vec_id"].to_numpy().astype(np.int64)
        out = {"query": own[row], "query_id": asked[row], "vec_id": ids[member], "tag": tags[member], "score": score}
    kinds = {"score": pa.float64()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 10,
    factor: float = 2.0,
    every: int = 100,
    shard_rows: int = 65_536,
    block_rows: int = 16_384,
    least_shards: int = 12,
    leaf: int = 64,
) -> DataFrame:
    """The ``k`` nearest rows of each query by Euclidean distance.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates
    all rows but the query's own. Returns ``query_id, rank, vec_id, score``,
    nearest first, ties to the smaller id, scores in double precision on the
    vectors as given. With ``factor`` one the search is exact.

    Rows take no part if the id or the vector is null, or the vector is empty,
    all zero, or holds a null, NaN or infinite component; vectors of another
    length are not compared. Fewer candidates give fewer rows, no queries or an
    empty table none. Repeated rows are candidates like any other, and repeated
    queries each get their rows. Other columns are ignored.

    Rows are dealt to shards, and queries to blocks, by the hash of a row
    number, so equal vectors or ids make no hot shard. A task holds one shard
    and one block, of bounded size at any scale.
    """
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(F.forall("embedding", ok) & F.exists("embedding", lambda x: x != 0))
    base = stage(rows.select(F.col("vec_id").cast("long"), "embedding", F.monotonically_increasing_id().alias("tag")))
    asked = base.where(F.col("vec_id") % every == 0)
    total, n_asked = base.count(), asked.count()
    shards = max(min(least_shards, total // 512 + 1), math.ceil(total / shard_rows))
    blocks = max(1, math.ceil(n_asked / block_rows))
    by_tag = F.xxhash64("tag", F.lit(41))
    shard, block = F.pmod(by_tag, F.lit(shards)).cast("int"), F.pmod(by_tag, F.lit(blocks)).cast("int")
    dim = F.size("embedding").alias("dim")
    # every cell is one shard and one block; a row goes to the cells of its shard
    sides = [
        base.select(dim, shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "vec_id", "tag", "embedding"),
        asked.select(dim, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), F.lit(True).alias("asks"), "vec_id", "tag", "embedding"),
    ]
    found = (
        sides[0]
        .union(sides[1])
        .groupBy("dim", "shard", "block")
        .applyInArrow(
            lambda table: nearest_in_cell(table, k, factor, leaf),
            "query long, query_id long, vec_id long, tag long, score double",
        )
    )
    order = Window.partitionBy("query").orderBy("score", "vec_id", "tag")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")

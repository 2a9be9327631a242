"""Sharding: exact sizes, gapless slots, and the laws of its draws."""

import zlib
from math import comb

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from twinfold.llm import sharding
from twinfold.llm.queries import op8_sharding


def test_hypergeometric_follows_its_law(spark):
    n = 20_000
    c = lambda x: F.lit(x).cast("bigint")
    u = (F.col("id") + 0.5) / n
    for pop, good, draws in ((30, 12, 7), (5, 5, 3), (9, 0, 4), (10, 3, 10), (1, 1, 0)):
        got = dict(spark.range(n).groupBy(sharding.hypergeometric(c(pop), c(good), c(draws), u)).count().collect())
        for k in range(draws + 1):
            want = comb(good, k) * comb(pop - good, draws - k) / comb(pop, draws)
            assert abs(got.get(k, 0) / n - want) < 2 / n + 1e-9


def test_hypergeometric_of_many(spark):
    c = lambda x: F.lit(x).cast("bigint")
    got = spark.range(500).select(
        sharding.hypergeometric(c(10**12), c(25 * 10**9), c(10**9), (F.col("id") + 0.5) / 500).alias("k")
    )
    mean, sd = got.agg(F.avg("k"), F.stddev("k")).first()
    assert abs(mean - 25e6) < 500 and abs(sd / (25e6 * 0.975 * 0.999) ** 0.5 - 1) < 0.1


def test_matrix_has_both_margins(spark):
    blocks = spark.createDataFrame([(i, (i * 37) % 11 * 40) for i in range(16)], "block long, n long")
    total = sum(r.n for r in blocks.collect())
    sizes = [total // 5 + (j < total % 5) for j in range(5)]
    rows = sharding.communication_matrix(blocks, 16, sizes, 3).collect()
    given = {r.block: r.n for r in blocks.collect()}
    assert {r.block: sum(r.counts) for r in rows} == given
    assert [sum(x) for x in zip(*[r.counts for r in rows], strict=True)] == sizes
    assert all(x >= 0 for r in rows for x in r.counts)


def checked(rows, n, shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by_shard.values())) == n
    sizes = [len(by_shard.get(j, [])) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_query(spark, small):
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    rows = op8_sharding(spark, small).collect()
    checked(rows, len(docs), 40)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


def test_uniform_places(spark):
    """Every row is as likely in every shard; rows next to each other too."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = [0] * 8
    together = 0
    for seed in range(4):
        rows = {r.doc_id: r.shard for r in sharding.shuffle_into_shards(docs, 8, seed, rows_per_block=100).collect()}
        for i in range(400):
            counts[rows[i]] += 1
        together += sum(rows[i] == rows[i + 1] for i in range(3999))
    assert all(abs(c - 200) < 60 for c in counts)
    assert abs(together / (4 * 3999) - 1 / 8) < 0.02


def test_odd_documents(spark, odd_documents):
    rows = sharding.shuffle_into_shards(odd_documents, 3).collect()
    checked(rows, 8, 3)
    assert sorted((r["size"], r.text_crc32) for r in rows if r.doc_id == 2) == [(16, 0)]
    assert sharding.shuffle_into_shards(odd_documents.where("false"), 3).count() == 0


def test_places_do_not_depend_on_the_layout(spark, monkeypatch):
    """The same rows in other partitions and another order get the same places."""
    monkeypatch.setattr(sharding, "PORTION", 7)
    rows = [(i % 90, f"text {i % 45}") for i in range(180)] + [(5, "hot")] * 100 + [(None, None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, sharding.shuffle_into_shards(docs, 6, rows_per_block=20).collect()))
    for other in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("text"))):
        got = sharding.shuffle_into_shards(other, 6, rows_per_block=20).collect()
        checked(got, len(rows), 6)
        assert sorted(map(str, got)) == want


def test_plan_has_no_nested_loop(spark, small):
    out = op8_sharding(spark, small)
    out.collect()
    blocks = spark.createDataFrame([(0, 3), (1, 4)], "block long, n long")
    plan = sharding.communication_matrix(blocks, 2, [3, 4], 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

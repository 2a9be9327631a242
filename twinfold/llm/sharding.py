"""Uniform shuffle into shards of exact size, by a communication matrix.

How many rows each source block sends to each shard is drawn first, from the
multivariate hypergeometric law, so the matrix has the block sizes as row sums
and the shard sizes as column sums. Rows are then permuted within their block,
cut by the matrix row, exchanged, and permuted again within their shard. All
of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.frames import pick, power_of_two, stage, unstage


#: Interchangeable rows that one task numbers.
PORTION = 4096


def _let(value: Column, body) -> Column:
    """Bind a value once for use in several places of an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """One exact-law draw by inversion: good items among ``draws`` of ``pop``.

    Weights run upward from ten standard deviations below the mean, each by
    its ratio to the last, and are normalised by their own sum; the tails left
    out hold less mass than a double resolves.
    """
    d = lambda c: c.cast("double")
    lo = F.greatest(F.lit(0).cast("long"), draws - (pop - good))
    hi = F.least(good, draws)
    share = d(good) / F.greatest(d(pop), F.lit(1.0))
    mean = d(draws) * share
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * d(pop - draws) / F.greatest(d(pop) - 1, F.lit(1.0))))
    reach = F.ceil(sd * 10).cast("long") + 10
    first = F.greatest(lo, F.floor(mean).cast("long") - reach)
    last = F.least(hi, F.floor(mean).cast("long") + reach)

    def ratio(k):
        return d(good - k) * d(draws - k) / (d(k + 1) * d(pop - good - draws + k + 1))

    def drawn(span):
        total = F.aggregate(
            span,
            F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("acc")),
            lambda s, k: F.struct((s["p"] * ratio(k)).alias("p"), (s["acc"] + s["p"]).alias("acc")),
            lambda s: s["acc"],
        )
        return _let(
            total * u,
            lambda mark: F.aggregate(
                span,
                F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("acc"), F.get(span, F.lit(0)).alias("k")),
                lambda s, k: F.struct(
                    (s["p"] * ratio(k)).alias("p"),
                    (s["acc"] + s["p"]).alias("acc"),
                    F.when(s["acc"] + s["p"] <= mark, k + 1).otherwise(s["k"]).alias("k"),
                ),
                lambda s: F.least(s["k"], F.element_at(span, -1)),
            ),
        )

    return _let(F.sequence(first, last), drawn)


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def communication_matrix(blocks: DataFrame, n_blocks: int, shard_sizes: list[int], seed: int) -> DataFrame:
    """Rows ``(block, counts)``: how many rows each block sends to each shard.

    ``blocks`` has ``(block, n)`` with blocks 0 to ``n_blocks`` - 1, a power
    of two. The shard vector of a range of blocks is split between its halves
    by a draw, level by level, so each level runs over all ranges in parallel.
    """
    spark, levels, n_shards = blocks.sparkSession, n_blocks.bit_length() - 1, len(shard_sizes)
    # not a literal, as that would leave a join without a condition
    node = spark.range(1).select(
        F.col("id").alias("block"), F.array(*[F.lit(s).cast("long") for s in shard_sizes]).alias("counts")
    )
    for level in range(1, levels + 1):
        left = (
            blocks.withColumn("half", F.shiftright("block", levels - level))
            .where("half % 2 = 0")
            .groupBy(F.shiftright("half", 1).alias("block"))
            .agg(F.sum("n").alias("n_left"))
        )
        node = node.join(left, "block", "left").withColumn("n_left", F.coalesce("n_left", F.lit(0).cast("long")))
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        taken = F.aggregate(
            F.sequence(F.lit(0), F.lit(n_shards - 1)),
            F.struct(
                F.col("n_left").alias("draws"), total.alias("pop"), F.array().cast("array<bigint>").alias("out")
            ),
            lambda s, j: _let(
                hypergeometric(
                    s["pop"],
                    F.get("counts", j),
                    s["draws"],
                    _uniform(F.lit(seed), F.lit(level), F.col("block"), j)  # noqa: B023,
                ),
                lambda k: F.struct(
                    (s["draws"] - k).alias("draws"),
                    (s["pop"] - F.get("counts", j)).alias("pop"),
                    F.concat(s["out"], F.array(k)).alias("out"),
                ),
            ),
            lambda s: s["out"],
        )
        node = (
            node.withColumn("taken", taken)
            .withColumn("rest", F.zip_with("counts", "taken", lambda a, b: a - b))
            .select("block", F.posexplode(F.array("taken", "rest")).alias("side", "counts"))
            .select((F.col("block") * 2 + F.col("side")).alias("block"), "counts")
        )
    return node


def shuffle_into_shards(
    docs: DataFrame, n_shards: int = 40, seed: int = 20240, rows_per_block: int = 100_000, least_blocks: int = 64
) -> DataFrame:
    """Place every row in one of ``n_shards`` shards, uniformly at random.

    Shard sizes differ by one row at most. Reads ``doc_id`` and ``text`` and
    returns ``doc_id, size, text_crc32, shard, slot``; other columns, clashing
    or not, are ignored. A null text has size 16 and the checksum of no bytes
    (0); a null id, repeated ids and repeated rows are rows like any other; an
    empty table gives an empty result. The placement is a function of the seed,
    the ids and the texts: it does not depend on how the input is partitioned
    or ordered, and a recomputed task repeats it.

    Rows with one id and text are interchangeable, so they are counted and
    then numbered, in portions that are dealt to all tasks. Blocks and the
    pieces of a shard hold about ``rows_per_block`` rows each, however skewed
    ids or texts are, because both come from a hash of id, text and number.
    """
    text = F.coalesce("text", F.lit(""))
    same = ["doc_id", "size", "text_crc32", "hash"]
    counted_rows = (
        pick(docs, "doc_id", "text")
        .select(
            "doc_id",
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
        )
        .groupBy(*same)
        .agg(F.count("*").alias("n"))
    )
    portion = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PORTION}"))).alias("portion")
    portions = counted_rows.select(*same, "n", portion).repartition("hash", "doc_id", "portion")
    number = F.explode(F.sequence(F.col("portion") * PORTION, F.least(F.col("n"), (F.col("portion") + 1) * PORTION) - 1))
    numbered = portions.select(*same, number.alias("number"))
    base = stage(numbered.withColumn("tag", F.xxhash64(F.lit(seed + 2), *same, "number")))
    total = base.count()
    n_blocks = power_of_two(max(least_blocks, total / rows_per_block))
    pieces = power_of_two(max(4, total / n_shards / rows_per_block))
    keyed = base.withColumn("r1", F.xxhash64(F.lit(seed), F.col("tag"))).withColumn(
        "block", F.shiftrightunsigned("r1", 64 - (n_blocks.bit_length() - 1))
    )
    by = [*same, "number"]  # should two rows share a hash
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    counted = stage(keyed.groupBy("block").agg(F.count("*").alias("n")))
    matrix = stage(communication_matrix(counted, n_blocks, sizes, seed))
    ends = matrix.select(
        "block",
        F.aggregate(
            "counts",
            F.array().cast("array<bigint>"),
            lambda a, x: F.concat(a, F.array(x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))),
        ).alias("ends"),
    )
    within = keyed.withColumn("p", F.row_number().over(Window.partitionBy("block").orderBy("r1", *by)))
    placed = stage(
        within.join(ends, "block").select(
            "doc_id",
            "size",
            "text_crc32",
            "hash",
            "number",
            F.size(F.filter("ends", lambda e: e < F.col("p"))).alias("shard"),
            F.xxhash64(F.lit(seed + 1), F.col("tag")).alias("r2"),
        )
    )
    placed = placed.withColumn("piece", F.shiftrightunsigned("r2", 64 - (pieces.bit_length() - 1)))
    offsets = (
        placed.groupBy("shard", "piece")
        .agg(F.count("*").alias("n"))
        .withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n"))
        .drop("n")
    )
    slot = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("r2", *by)) - 1
    out = placed.withColumn("rank", slot).join(offsets, ["shard", "piece"])
    unstage(base, counted, matrix)
    return out.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot")
    )

"""Token counts from an exact histogram of encoded lengths.

Documents are counted by encoded length; everything else is read off the
histogram. Sums over all longer and all shorter lengths, kept beside every
length, answer totals, quantiles and truncated totals for any context limit
without another pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.frames import pick, stage

#: Lengths that one window task sums; the blocks of them are summed apart.
BLOCK = 4096


def length_histogram(encoded: DataFrame, by: list[str] = [], length: str = "n_tokens") -> DataFrame:  # noqa: B006
    """Rows ``(*by, n_tokens, n_docs, ...)``: one for each length that occurs.

    ``docs_at_least`` and ``tokens_at_least`` are suffix sums over the lengths
    from this one on, ``docs_below`` and ``tokens_below`` the prefix sums
    before it. A null length counts as 0, a null in ``by`` is a value of its
    own, repeated rows count each, and no rows give no rows. Other columns are
    ignored, whatever their names.

    Lengths are counted before the shuffle, so a hot value of ``by`` costs a
    row for each of its lengths. Windows run within blocks of lengths and over
    the block totals, never over the whole histogram in one task.
    """
    # read twice, so the documents must not be encoded twice
    counts = stage(
        pick(encoded, *by, length).select(*by, F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long")).alias("n_tokens"))
        .groupBy(*by, "n_tokens")
        .agg(F.count("*").alias("n_docs"))
        .withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    )
    blocks = counts.groupBy(*by, "block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    over_blocks = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = over_blocks.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("block").alias("_block"),
        F.coalesce(F.sum("bd").over(before), zero).alias("before_docs"),
        F.coalesce(F.sum("bt").over(before), zero).alias("before_tokens"),
        F.sum("bd").over(over_blocks).alias("all_docs"),
        F.sum("bt").over(over_blocks).alias("all_tokens"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("block") == F.col("_block")]
    joined = counts.join(blocks, same)
    within = Window.partitionBy(*by, "block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    below_docs = F.col("before_docs") + F.coalesce(F.sum("n_docs").over(within), zero)
    below_tokens = F.col("before_tokens") + F.coalesce(F.sum("tokens").over(within), zero)
    return (
        joined.withColumn("docs_below", below_docs)
        .withColumn("tokens_below", below_tokens)
        .select(
            *by,
            "n_tokens",
            "n_docs",
            "docs_below",
            "tokens_below",
            (F.col("all_docs") - F.col("docs_below")).alias("docs_at_least"),
            (F.col("all_tokens") - F.col("tokens_below")).alias("tokens_at_least"),
        )
    )


def truncated_totals(histogram: DataFrame, limits: list[int], by: list[str] = []) -> DataFrame:  # noqa: B006
    """For each context limit the tokens that remain when texts are cut there.

    A limit needs one row of each group, that of the next length: documents
    below keep all their tokens, the others as many as the limit. A limit
    beyond the longest document truncates nothing. ``limits`` is a short list;
    rows ``(*by, context, tokens_kept, docs_truncated)``, one for each limit,
    also of a null group; an empty histogram gives none. The histogram has one
    row for each length; its other columns are ignored.
    """
    needed = ["n_tokens", "n_docs", "docs_below", "tokens_below", "docs_at_least", "tokens_at_least"]
    rows = pick(histogram, *by, *needed).withColumn("context", F.explode(F.array(*[F.lit(int(x)) for x in limits]).cast("array<bigint>")))
    reached = F.when(F.col("n_tokens") >= F.col("context"), F.col("n_tokens"))
    longer = F.col("docs_at_least") - F.when(F.col("n_tokens") == F.col("context"), F.col("n_docs")).otherwise(0)
    kept = F.col("tokens_below") + F.col("context") * F.col("docs_at_least")
    best = rows.groupBy(*by, "context").agg(
        F.min_by(F.struct(kept.alias("kept"), longer.alias("longer")), reached).alias("next"),
        F.max(F.col("tokens_below") + F.col("tokens_at_least")).alias("all_tokens"),
    )
    zero = F.lit(0).cast("long")
    return best.select(
        *by,
        "context",
        F.coalesce("next.kept", "all_tokens").alias("tokens_kept"),
        F.coalesce("next.longer", zero).alias("docs_truncated"),
    )


def length_quantiles(histogram: DataFrame, shares: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """For each share in (0, 1] the least length that so many documents have at most.

    Ties and repeated lengths need no rule, as a length is one row of the
    histogram; a null group has its own quantiles; an empty histogram gives
    none; other columns are ignored.
    """
    histogram = pick(histogram, *by, "n_tokens", "n_docs", "docs_below", "docs_at_least")
    docs = F.col("docs_below") + F.col("docs_at_least")
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    rows = histogram.select(*by, "n_tokens", "n_docs", "docs_below", docs.alias("all_docs"), wanted)
    rank = F.greatest(F.ceil(F.col("share") * F.col("all_docs")).cast("long"), F.lit(1).cast("long"))
    return rows.where((rank > F.col("docs_below")) & (rank <= F.col("docs_below") + F.col("n_docs"))).select(
        *by, "share", "n_tokens"
    )

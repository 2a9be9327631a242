"""Duplicate elimination, composed of the fingerprints and tables of the engine.

These are compositions of this engine's own: whole values, fixed-size chunks,
and the two-level match of a weak and a strong checksum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.bytes import long
from twinfold.functions.digests import md5_hex


def fingerprints(df: DataFrame, key: str, data: str) -> DataFrame:
    """``fingerprint, canonical, refs``: one row for each distinct value.

    ``canonical`` is the smallest key that has it, ``refs`` how many rows do.
    Null values are one value with a null fingerprint, apart from empty ones;
    a null key is never canonical unless all keys of the value are null; no
    rows give none. Only digests are shuffled, summed before the exchange.
    """
    rows = df.select(F.col(key).alias("key"), md5_hex(F.col(data)).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.min("key").alias("canonical"), F.count("*").alias("refs"))


def canonical_map(df: DataFrame, key: str, data: str) -> DataFrame:
    """``key, fingerprint, canonical``: for every row the row that stands for it.

    Null values stand for each other, under a null fingerprint. Repeated rows
    are rows like any other.
    """
    rows = df.select(F.col(key).alias("key"), md5_hex(F.col(data)).alias("fingerprint"))
    first = rows.groupBy("fingerprint").agg(F.min("key").alias("canonical"))
    same = first.withColumnRenamed("fingerprint", "_f")
    return rows.join(same, F.col("fingerprint").eqNullSafe(F.col("_f"))).select("key", "fingerprint", "canonical")


def fixed_chunks(df: DataFrame, key: str, data: str, size: int = 512) -> DataFrame:
    """``key, chunk, content``: consecutive pieces of ``size`` bytes, the last
    one shorter. Empty and null values have no chunks."""
    if size < 1:
        raise ValueError("chunks must have at least one byte")
    blob = F.col(data).cast("binary")
    count = F.ceil(F.octet_length(blob) / size).cast("int")
    pieces = F.when(
        count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(blob, i * size + 1, F.lit(size)))
    )
    return df.select(F.col(key).alias("key"), F.posexplode(pieces).alias("chunk", "content"))


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """``fingerprint, bytes, refs`` of the distinct chunks; contents stay behind."""
    rows = chunks.select(md5_hex(F.col("content")).alias("fingerprint"), F.octet_length("content").alias("bytes"))
    return rows.groupBy("fingerprint").agg(F.max("bytes").cast("bigint").alias("bytes"), F.count("*").alias("refs"))


def chunk_savings(chunks: DataFrame) -> DataFrame:
    """One row: chunks and bytes in all, chunks and bytes that differ."""
    return unique_chunks(chunks).agg(
        F.coalesce(F.sum("refs"), long(0)).alias("chunks"),
        F.coalesce(F.sum(F.col("bytes") * F.col("refs")), long(0)).alias("bytes"),
        F.count("*").alias("unique_chunks"),
        F.coalesce(F.sum("bytes"), long(0)).alias("unique_bytes"),
    )


def two_level_match(df: DataFrame, key: str, data: str, weak: Column) -> DataFrame:
    """``key, canonical``: rows whose value repeats that of a smaller key.

    A weak checksum and the length find what may repeat, the digest decides.
    Null values repeat nothing, and neither do null keys; rows that repeat key
    and value are the same row.
    Checksums and digests are shuffled, values are not.
    """
    rows = df.select(
        F.col(key).alias("key"), weak.alias("weak"), F.octet_length(data).alias("size"), md5_hex(F.col(data)).alias("strong")
    )
    shared = rows.groupBy("weak", "size").agg(F.count("*").alias("n")).where("n > 1").select("weak", "size")
    maybe = rows.join(shared, ["weak", "size"], "left_semi").select("key", "strong")
    first = maybe.groupBy("strong").agg(F.min("key").alias("canonical"))
    return maybe.join(first, "strong").where("key != canonical").select("key", "canonical")

"""Digests: MD5 in hexadecimal and raw form, and bytes as hexadecimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_hex(data: Column) -> Column:
    """MD5 as 32 lower-case hexadecimal digits; null for null."""
    return F.md5(data.cast("binary"))


def md5_raw(data: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(md5_hex(data))


def md5_parts(*parts: Column) -> Column:
    """MD5 of parts taken one after another, as if hashed piece by piece.

    Null parts count as empty.
    """
    empty = F.lit("").cast("binary")
    return F.md5(F.concat(*[F.coalesce(p.cast("binary"), empty) for p in parts]))


def bytes_to_hex(data: Column, upper: bool = True) -> Column:
    """Two hexadecimal digits for every byte."""
    out = F.hex(data.cast("binary"))
    return out if upper else F.lower(out)

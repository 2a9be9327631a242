"""Unsigned 32-bit values live in a BIGINT between 0 and 2**32 - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(value: int) -> Column:
    return F.lit(value).cast("bigint")

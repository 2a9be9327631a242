"""Lookups of probes in a table by key, whatever the columns of the probes are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position(df: DataFrame, name: str) -> int:
    """Place of a column: an exactly spelt one wins over one that differs in
    case, and of several columns with one name the first counts."""
    columns = df.columns
    folded = [c.lower() for c in columns]
    if name in columns:
        return columns.index(name)
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"column {name!r} is missing; the frame has {columns}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Some columns by name, whatever else the frame holds."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(
        *[F.col(f"_{position(df, n)}").alias(n) for n in names]
    )


def look_up(
    probes: DataFrame, key: str, found: DataFrame, added: dict[str, Column], normalize: Callable[[Column], Column] = lambda k: k
) -> DataFrame:
    """All probes with columns from ``found``, whose key is called ``_key``.

    ``added`` says how each new column comes from those of ``found``, null
    where nothing was found. A probe column named like a new one, in any case,
    is replaced; all others pass through, whatever their names. Null keys find
    nothing, repeated probes are looked up alike.
    """
    taken = {a.lower() for a in added}
    kept = [i for i, c in enumerate(probes.columns) if c.lower() not in taken]
    plain = probes.toDF(*[f"_{i}" for i in range(len(probes.columns))])
    joined = plain.join(found, normalize(F.col(f"_{position(probes, key)}")) == F.col("_key"), "left")
    out = joined.select(*[F.col(f"_{i}") for i in kept], *[c.alias(a) for a, c in added.items()])
    return out.toDF(*[probes.columns[i] for i in kept], *added)


def among(probes: DataFrame, key: str, found: DataFrame, normalize: Callable[[Column], Column] = lambda k: k) -> DataFrame:
    """The probes whose key is a ``_key`` of ``found``, with the columns they came with."""
    plain = probes.toDF(*[f"_{i}" for i in range(len(probes.columns))])
    some = plain.join(found.select("_key"), normalize(F.col(f"_{position(probes, key)}")) == F.col("_key"), "left_semi")
    return some.toDF(*probes.columns)

"""Numbers and paths as text: decimal digits, extensions, lists, target paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uint2str(x: Column) -> Column:
    """Decimal digits of an unsigned number; zero has none, so it gives ``""``."""
    return F.when(x == 0, F.lit("")).otherwise(x.cast("string"))


def uint2str_length(x: Column) -> Column:
    """How many digits ``uint2str`` gives: 0 for zero."""
    return F.length(uint2str(x))


def file_ext(path: Column) -> Column:
    """What follows the last dot, wherever it stands; null without a dot."""
    return F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1))


def in_list(path: Column, paths: list[str]) -> Column:
    """Whether a path is one of a short list; false for an empty list.

    A literal list reaches the Parquet scan as an ``In`` filter.
    """
    return F.coalesce(path.isin(list(paths)), F.lit(False)) if paths else F.lit(False)


def semi_list(df: DataFrame, column: str, paths: DataFrame, path_column: str = "path") -> DataFrame:
    """The rows whose path is in a table of paths, of any size."""
    wanted = paths.select(F.col(path_column).alias("_listed")).distinct()
    return df.join(wanted, df[column] == F.col("_listed"), "left_semi")


def target_path(filename: Column, base: Column) -> Column:
    """``base/filename`` without a drive letter.

    A drive is one ASCII character before a colon; slashes are kept as they
    are, so an absolute name gives two in a row.
    """
    return F.concat(base, F.lit("/"), F.regexp_replace(filename, r"^[\x00-\x7F]:", ""))


def target_directories(path: Column) -> Column:
    """Every prefix of a path that ends before a slash: the directories that
    writing to it creates, outermost first. The last component is not one."""
    parts = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    none = F.array().cast("array<string>")
    some = F.array_distinct(F.filter(prefixes, lambda p: p != ""))
    return F.when(F.size(parts) < 2, none).when(path.isNotNull(), some)


def compare_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes, case-sensitive; null if either is null."""
    x, y = a.cast("binary"), b.cast("binary")
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)

"""An array of fixed-width values by index, as rows ``(idx, value)``."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.lookup import look_up, pick
from twinfold.sources.files import path_exists, remove_path

#: Operation codes of ``apply``.
VALUE_SET, VALUE_GET = 0, 1
SCHEMA = "idx long, value binary"


class ListDB:
    """An indexed array whose values all have ``unit_size`` bytes.

    ``setvalue`` returns a new array, as frames do not change; ``save`` and
    ``open`` keep one as Parquet. A value of another width raises when it is
    read. Indexes that were never set have no value.
    """

    def __init__(self, rows: DataFrame, unit_size: int):
        if unit_size < 1:
            raise ValueError("values must have at least one byte")
        self.rows, self.unit_size = rows, unit_size

    @classmethod
    def empty(cls, spark: SparkSession, unit_size: int) -> ListDB:
        return cls(spark.createDataFrame([], SCHEMA), unit_size)

    @classmethod
    def open(cls, spark: SparkSession, path: str, unit_size: int) -> ListDB:
        """The saved array, or an empty one if there is none."""
        if not path_exists(spark, path):
            return cls.empty(spark, unit_size)
        return cls(spark.read.schema(SCHEMA).parquet(path), unit_size)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @staticmethod
    def unlink(spark: SparkSession, path: str) -> bool:
        return remove_path(spark, path)

    def cached(self) -> ListDB:
        """The same array, held in memory as far as it fits and on disk beyond."""
        return ListDB(self.rows.persist(StorageLevel.MEMORY_AND_DISK), self.unit_size)

    def setvalue(self, writes: DataFrame) -> ListDB:
        """Set ``(seq, idx, value)``; of several writes of an index the highest
        ``seq`` counts, and any write replaces what was there."""
        value = F.col("value").cast("binary")
        checked = F.when(F.octet_length(value) != self.unit_size, F.raise_error(F.lit("value of another width"))).otherwise(value)
        fresh = pick(writes, "seq", "idx", "value").select(F.col("idx").cast("bigint"), checked.alias("value"), F.col("seq").cast("bigint"))
        old = self.rows.select("idx", "value", F.lit(None).cast("bigint").alias("seq"))
        order = F.struct(F.col("seq").isNotNull(), "seq")
        best = F.max_by(F.struct("value"), order).alias("best")
        rows = old.unionByName(fresh).groupBy("idx").agg(best).select("idx", F.col("best.value").alias("value"))
        return ListDB(rows, self.unit_size)

    def getvalue(self, probes: DataFrame, idx: str = "idx") -> DataFrame:
        """The probes with ``value``; null where nothing was set.

        A probe column called ``value`` is replaced, others pass through.
        """
        found = self.rows.select(F.col("idx").alias("_key"), F.col("value").alias("_value"))
        return look_up(probes, idx, found, {"value": F.col("_value")})

    def apply(self, op: int, rows: DataFrame) -> ListDB | DataFrame:
        """``setvalue`` or ``getvalue`` by code."""
        if op not in (VALUE_SET, VALUE_GET):
            raise ValueError(f"no such operation: {op}")
        return self.setvalue(rows) if op == VALUE_SET else self.getvalue(rows)

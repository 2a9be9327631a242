"""Tables of a folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table with less than this for each core is small: dealing it anew costs little.
SMALL_PART = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """Deal a small table to all cores if its files would keep most of them idle.

    A file of one row group is one task, however much work its rows are. Only a
    plain scan may be given, and one with enough partitions, or too large to
    be moved for nothing, comes back as it is: at scale nothing is shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * SMALL_PART or table.rdd.getNumPartitions() >= 2 * cores:
        return table
    return table.repartition(cores)

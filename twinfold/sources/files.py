"""Files as rows, and the few things that are done to whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.digests import md5_hex
from twinfold.functions.filetype import file_type
from twinfold.functions.paths import file_ext


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """One row for each file: ``path, modificationTime, length, content``.

    A missing path raises. The content is read only if a query uses it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def file_digests(files: DataFrame) -> DataFrame:
    """``path, length, md5`` of every file."""
    return files.select("path", "length", md5_hex(F.col("content")).alias("md5"))


def file_types(files: DataFrame) -> DataFrame:
    """``path, ext, type``: by name, and by the first bytes."""
    return files.select("path", file_ext(F.col("path")).alias("ext"), file_type(F.col("content")).alias("type"))


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder wherever it is stored; false if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

"""A key/value table kept as Parquet: string keys, binary values of any length.

Inserts append segments; of several values of a key the last one written is
the one that is read. The table lasts as long as the session that uses it: it
is deleted on close, unless it is asked to stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.bytes import long
from twinfold.functions.hashes import ap_hash, js_hash
from twinfold.operators.lookup import among, look_up, pick
from twinfold.sources.files import path_exists, remove_path
from twinfold.sources.staging import forget, track

SCHEMA = "segment long, seq long, key string, value binary"


class BigTable:
    """A context manager over the folder of one table.

    ``path`` opens an existing table or creates one there; without it, a name
    is generated below ``root`` (default: ``bigtable`` in the warehouse).
    ``is_new`` tells which. A table that exists but cannot be read raises.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, root: str | None = None, keep: bool = False):
        self.spark, self.keep = spark, keep
        root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/bigtable"
        self.path = path or f"{root}/table_{uuid.uuid4().hex}"
        self.is_new = not path_exists(spark, self.path)
        if self.is_new:
            spark.createDataFrame([], SCHEMA).write.parquet(self.path)
        if not keep:
            track(spark, self.path)
        self.segment = 0 if self.is_new else (self._rows().agg(F.max("segment")).first()[0] or 0)

    def __enter__(self) -> BigTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete the table, unless it is kept."""
        if not self.keep:
            remove_path(self.spark, self.path)
            remove_path(self.spark, self._filter_path)
            forget(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def insert(self, rows: DataFrame) -> None:
        """Append ``(seq, key, value)``; the highest ``seq`` of a key counts.

        Without a ``seq`` column, keys must be unique within one call. A null
        key raises; a null value is stored as an empty one. Other columns are
        ignored.
        """
        numbered = "seq" in [c.lower() for c in rows.columns]
        given = pick(rows, "key", "value", *["seq"] * numbered)
        key = F.when(F.col("key").isNull(), F.raise_error(F.lit("null key"))).otherwise(F.col("key"))
        seq = F.col("seq").cast("bigint") if numbered else F.lit(0).cast("bigint")
        value = F.coalesce(F.col("value").cast("binary"), F.lit("").cast("binary"))
        self.segment += 1
        given.select(
            F.lit(self.segment).cast("bigint").alias("segment"),
            seq.alias("seq"),
            key.alias("key"),
            value.alias("value"),
        ).write.mode("append").parquet(self.path)

    def state(self) -> DataFrame:
        """``key, value, value_size`` of every key."""
        return last_values(self._rows(), F.struct("segment", "seq"))

    def get(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes with ``value`` (null if absent) and ``value_size`` (then 0).

        The last write of each probed key is found without the values; only
        those writes are then read. Probe columns called like the new ones are
        replaced, others pass through.
        """
        order = F.struct("segment", "seq")
        asked = pick(probes, key).select(F.col(key).alias("key")).distinct()
        narrow = self._rows().select("key", "segment", "seq").join(asked, "key", "left_semi")
        last = narrow.groupBy("key").agg(F.max(order).alias("last")).select("key", "last.segment", "last.seq")
        found = last_values(self._rows().join(last, ["key", "segment", "seq"], "left_semi"), order)
        added = {"value": F.col("_value"), "value_size": F.coalesce("_size", F.lit(0))}
        return look_up(probes, key, found.toDF("_key", "_value", "_size"), added)

    def contains(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes with ``contained``; an empty value counts as contained.

        A probe column called ``contained`` is replaced, others pass through.
        """
        found = self._rows().select(F.col("key").alias("_key")).distinct()
        return look_up(probes, key, found, {"contained": F.col("_key").isNotNull()})

    def containing(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes that are contained, as a semi join."""
        return among(probes, key, self._rows().select(F.col("key").alias("_key")))

    @property
    def _filter_path(self) -> str:
        return f"{self.path}_filter"

    def write_filter(self, bits: int = 1 << 20) -> None:
        """Write the negative-lookup filter of the keys stored so far.

        A Bloom filter of two published hashes, as rows of 64 bits: ``bits``
        bounds it whatever the table holds, so it is small enough to broadcast.
        """
        rows = self._rows().select("key").distinct()
        words = rows.select(F.explode(filter_places(F.col("key"), bits)).alias("at"))
        words = words.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("set"))
        words.withColumn("bits", F.lit(bits)).write.mode("overwrite").parquet(self._filter_path)

    def may_contain(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes with ``may_contain``: false only if the key was not stored
        when the filter was written; null for a null key. Values are not read.

        A probe column called ``may_contain`` is replaced, others pass through.
        """
        words = self.spark.read.schema("word long, set long, bits int").parquet(self._filter_path)
        bits = words.agg(F.max("bits")).first()[0] or 1
        keys = pick(probes, key).select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
        at = keys.select("_key", F.explode(filter_places(F.col("_key"), bits)).alias("at"))
        # one row for each 64 bits of the filter, whose size is fixed
        hit = at.join(F.broadcast(words.select("word", "set")), F.shiftright("at", 6) == F.col("word"), "left")
        on = F.coalesce(F.col("set").bitwiseAND(_bit(F.col("at"))) != 0, F.lit(False))
        return look_up(probes, key, hit.groupBy("_key").agg(F.min(on).alias("_on")), {"may_contain": F.col("_on")})


def filter_places(key: Column, bits: int) -> Column:
    """The bits of the filter that a key sets."""
    return F.array(*[F.pmod(h(key), long(bits)) for h in (ap_hash, js_hash)])


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", long(1), at.bitwiseAND(long(63)).cast("int"))


def last_values(rows: DataFrame, order) -> DataFrame:
    """``key, value, value_size``: for each key the value of the highest order."""
    best = F.max_by(F.struct("value"), order).alias("best")
    return (
        rows.groupBy("key")
        .agg(best)
        .select("key", F.col("best.value").alias("value"), F.coalesce(F.octet_length("best.value"), F.lit(0)).alias("value_size"))
    )

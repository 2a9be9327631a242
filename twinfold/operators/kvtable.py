"""A counted key/value table over an ordered log of operations.

The table is a multiset: every insert of a key adds an entry and overwrites the
data of all entries of that key; a remove takes one entry away, and is nothing
if there is none. So the multiplicity of a key is the running sum of +1 and -1
that never falls below zero, and its data are those of the last insert.

The running sum S with its running minimum gives the multiplicity without a
loop: ``S - least(0, min S)``. Sums and minima of consecutive stretches of the
log combine, so the log is cut into stretches and no key, however hot, has to
pass through one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.operators.lookup import among, look_up
from twinfold.sources.staging import scope, stage

#: Operations in one stretch of a log.
STRETCH = 65_536
#: Operations whose capacity changes one fold follows, and folds or sums combined at once.
FOLD, FAN = 16_384, 256

LOG = "seq long, op string, key string, data string"


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _sum_before(column: str, keys: list[str], order: str) -> Column:
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), _zero())


def _by_rank(rows: DataFrame, size: int) -> DataFrame:
    """Rows with ``part``: consecutive runs of about ``size`` rows by ``seq``.

    The bounds are drawn from a sample when the rows are dealt, so whoever
    reads the parts twice has to write them down first.
    """
    parts = max(1, -(-rows.count() // size))
    return rows.repartitionByRange(parts, "seq").withColumn("part", F.spark_partition_id().cast("bigint"))


def capacity_family(initial: int, most_entries: int) -> list[int]:
    """All capacities that doublings and integer halvings can lead to.

    They are halvings of the initial one, doubled any number of times; nothing
    grows beyond four times the most entries, or the initial capacity.
    """
    out, base = set(), initial
    top = max(initial, 4 * most_entries + 4)
    while True:
        size = base
        out.add(size)
        while 0 < size <= top:
            size *= 2
            out.add(size)
        if base == 0:
            return sorted(out)
        base //= 2


class HashTable:
    """Inserts, removes and lookups by key, over a log ``(seq, op, key, data)``.

    ``op`` is ``I`` or ``R`` and ``seq`` unique. A null key raises when the
    log is read, and so does an initial size of one or less at once. With
    ``key_normalizer``, keys that it makes equal are one key, whose spelling is
    that of the last insert. Data may be null; such a key has a size but does
    not exist for ``exist``.
    """

    def __init__(
        self,
        log: DataFrame,
        init_size: int = 997,
        key_normalizer: Callable[[Column], Column] | None = None,
    ):
        if init_size <= 1:
            raise ValueError("the initial size must exceed 1")
        self.init_size = init_size
        self.normalize = key_normalizer or (lambda k: k)
        given = F.when(F.col("key").isNull(), F.raise_error(F.lit("null key"))).otherwise(F.col("key"))
        self.log = log.select(F.col("seq").cast("bigint"), "op", given.alias("key"), "data")

    @classmethod
    def empty(cls, spark: SparkSession, **options) -> HashTable:
        return cls(spark.createDataFrame([], LOG), **options)

    def _with(self, rows: DataFrame) -> HashTable:
        """A table whose log goes on with more rows; their numbers say where."""
        return HashTable(self.log.unionByName(rows), self.init_size, self.normalize)

    def insert(self, rows: DataFrame) -> HashTable:
        """Append inserts from ``(seq, key, data)``; without ``data``, it is ``"1"``."""
        data = F.col("data").cast("string") if "data" in rows.columns else F.lit("1")
        return self._with(rows.select("seq", F.lit("I").alias("op"), "key", data.alias("data")))

    def remove(self, rows: DataFrame) -> HashTable:
        """Append removes from ``(seq, key)``: one entry of the key for each."""
        null = F.lit(None).cast("string")
        return self._with(rows.select("seq", F.lit("R").alias("op"), "key", null.alias("data")))

    def _width(self) -> int:
        """Sequence numbers that one stretch spans: so many that the log has a
        stretch for each ``STRETCH`` operations, however far apart they are."""
        n, low, high = self.log.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
        return max(1, -(-(high - low + 1) // -(-n // STRETCH))) if n else 1

    def _stretches(self) -> DataFrame:
        """For each key and stretch the sum, the least running sum, the last insert."""
        delta = F.when(F.col("op") == "I", 1).otherwise(-1).cast("bigint")
        rows = self.log.select(
            "seq",
            self.normalize(F.col("key")).alias("k"),
            F.expr(f"seq div {self._width()}").alias("stretch"),
            delta.alias("delta"),
            F.when(F.col("op") == "I", F.struct("seq", "key", "data")).alias("put"),
        )
        running = F.sum("delta").over(
            Window.partitionBy("k", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        )
        return (
            rows.withColumn("running", running)
            .groupBy("k", "stretch")
            .agg(F.sum("delta").alias("sum"), F.min("running").alias("low"), F.max("put").alias("put"))
        )

    def state(self) -> DataFrame:
        """``key, multiplicity, data`` of every live key.

        ``put`` compares by its sequence number first, so its maximum is the
        last insert, null data included.
        """
        parts = self._stretches().withColumn("before", _sum_before("sum", ["k"], "stretch"))
        keys = parts.groupBy("k").agg(
            F.sum("sum").alias("sum"), F.min(F.col("before") + F.col("low")).alias("low"), F.max("put").alias("put")
        )
        left = F.col("sum") - F.least(_zero(), "low")
        return keys.where(left > 0).select(F.col("put.key").alias("key"), left.alias("multiplicity"), F.col("put.data").alias("data"))

    def size(self) -> DataFrame:
        """One row: ``size`` counts entries, ``keys`` distinct live keys."""
        return self.state().agg(
            F.coalesce(F.sum("multiplicity"), _zero()).alias("size"), F.count("*").alias("keys")
        )

    def is_empty(self) -> DataFrame:
        """One row: whether no entry is left."""
        return self.size().select((F.col("size") == 0).alias("is_empty"))

    def _found(self) -> DataFrame:
        return self.state().select(self.normalize(F.col("key")).alias("_key"), F.col("data").alias("_data"))

    def search(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes with ``data`` of their key, null if it is absent.

        A probe column called ``data`` is replaced, others pass through.
        """
        return look_up(probes, key, self._found(), {"data": F.col("_data")}, self.normalize)

    def exist(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes with ``exists``: whether a search finds data that are not null.

        A probe column called ``exists`` is replaced, others pass through.
        """
        return look_up(probes, key, self._found(), {"exists": F.col("_data").isNotNull()}, self.normalize)

    def existing(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes that exist, as a semi join."""
        return among(probes, key, self._found().where("_data IS NOT NULL"), self.normalize)

    def running_sizes(self) -> DataFrame:
        """``seq, op, n``: the number of entries after every operation.

        The log is cut by rank into parts of about ``STRETCH`` operations, so
        sparse or crowded numbers make neither tiny nor huge parts, and the
        parts' sums are summed on two levels, so no task has all of them.
        """
        delta = F.when(F.col("op") == "I", 1).otherwise(-1).cast("bigint")
        rows = stage(_by_rank(self.log.select("seq", "op", self.normalize(F.col("key")).alias("k"), delta.alias("delta")), STRETCH))
        within = Window.partitionBy("k", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("s", F.sum("delta").over(within)).withColumn("m", F.min("s").over(within))
        parts = rows.groupBy("k", "part").agg(F.sum("delta").alias("sum"), F.min("s").alias("low"))
        before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("s0", _sum_before("sum", ["k"], "part"))
        parts = parts.withColumn("m0", F.coalesce(F.min(F.col("s0") + F.col("low")).over(before), _zero()))
        joined = rows.join(parts.select("k", "part", "s0", "m0"), ["k", "part"])
        left = F.col("s0") + F.col("s") - F.least(_zero(), "m0", F.col("s0") + F.col("m"))
        # the change of this one operation: of the multiplicity before it, at
        # the start of a part, what came before
        previous = F.lag("left").over(Window.partitionBy("k", "part").orderBy("seq"))
        start = F.col("s0") - F.least(_zero(), "m0")
        changed = joined.withColumn("left", left).withColumn("change", F.col("left") - F.coalesce(previous, start))
        order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        sums = changed.groupBy("part").agg(F.sum("change").alias("sum"))
        # a part of parts: sums within it, and sums of those before it
        above = F.floor(F.col("part") / FAN)
        sums = sums.withColumn("above", above).withColumn("n1", _sum_before("sum", ["above"], "part"))
        tops = sums.groupBy("above").agg(F.sum("sum").alias("sum")).withColumn("n2", _sum_before("sum", [], "above"))
        sums = sums.join(tops.select("above", "n2"), "above").select("part", (F.col("n1") + F.col("n2")).alias("n0"))
        own = changed.withColumn("n", F.sum("change").over(order))
        return own.join(sums, "part").select("seq", "op", (F.col("n0") + F.col("n")).alias("n"))

    def capacity(self) -> DataFrame:
        """One row ``capacity``: buckets after all growing and shrinking.

        After an insert the table doubles if it is at least half full, after a
        remove it halves if one to an eighth of it is left, a remove that found
        nothing included. That is a fold over the whole log; folds of parts are
        functions of the capacity they begin with, and there are few
        capacities, so parts are folded apart and the functions composed.
        """
        return self.capacities([self.init_size]).select("capacity")

    def capacities(self, initial: list[int]) -> DataFrame:
        """``init_size, capacity`` for each of several initial sizes, from one
        reading of the log."""
        if min(initial) <= 1:
            raise ValueError("the initial size must exceed 1")
        spark = self.log.sparkSession
        with scope() as keep:
            sizes = stage(self.running_sizes())
            top = sizes.agg(F.max("n")).first()[0]
            ranked = keep(stage(_by_rank(sizes, FOLD)))
        starts = F.explode(F.array(*[F.lit(c).cast("bigint") for c in initial])).alias("init_size")
        if top is None:
            return spark.range(1).select(starts).withColumn("capacity", F.col("init_size"))
        family = sorted(set().union(*[capacity_family(c, top) for c in initial]))
        every = F.array(*[F.lit(c).cast("bigint") for c in family])

        def step(sizes_so_far: Column, e: Column) -> Column:
            def one(c: Column) -> Column:
                grown = (e["op"] == "I") & (e["n"] >= F.floor(c / 2))
                shrunk = (e["op"] == "R") & (e["n"] > 0) & (e["n"] <= F.floor(c / 8))
                return F.when(grown, c * 2).when(shrunk, F.floor(c / 2)).otherwise(c)

            return F.transform(sizes_so_far, one)

        ops = F.array_sort(F.collect_list(F.struct("seq", "op", "n")))  # about FOLD of them
        maps = ranked.groupBy("part").agg(ops.alias("ops"))
        maps = maps.select("part", F.aggregate("ops", every, step).alias("to"))
        place = lambda c: F.array_position(every, c).cast("int")
        parts = F.array_sort(F.collect_list(F.struct("part", "to"))).alias("parts")
        spread = ranked.agg(F.max("part")).first()[0] + 1
        while spread > FAN:
            maps = maps.groupBy(F.floor(F.col("part") / FAN).alias("above")).agg(parts)
            composed = F.aggregate(
                "parts", every, lambda now, p: F.transform(now, lambda c: F.element_at(p["to"], place(c)))
            )
            maps = maps.select(F.col("above").alias("part"), composed.alias("to"))
            spread = spread // FAN + 1
        end = F.aggregate("parts", F.col("init_size"), lambda c, p: F.element_at(p["to"], place(c)))
        return maps.agg(parts).select("parts", starts).select("init_size", end.alias("capacity"))

"""The registered queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import checksums, digests, filetype, paths
from twinfold.functions.bytes import long
from twinfold.functions.hashes import HASHES, bucket
from twinfold.operators import dedup
from twinfold.operators.bigtable import BigTable
from twinfold.operators.kvtable import HashTable
from twinfold.operators.listdb import VALUE_GET, VALUE_SET, ListDB
from twinfold.sources import files, staging
from twinfold.sources.files import path_exists
from twinfold.sources.tables import read_table as _table
from twinfold.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register




# --- the counted table, over a log made from the events ---------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views insert, all else removes; low values carry null data."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("click", "view"), "I").otherwise("R").alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.when(F.col("value") >= 20, F.col("event_type")).alias("data"),
    )


_LOG_SQL = """
log AS (SELECT event_id AS seq, event_type IN ('click', 'view') AS put, CAST(user_id AS VARCHAR) AS key,
               CASE WHEN value >= 20 THEN event_type END AS data FROM events),
running AS (SELECT *, sum(CASE WHEN put THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY seq) AS s FROM log),
keys AS (SELECT key, max_by(s, seq) - least(0, min(s)) AS m, arg_max_null(data, seq) FILTER (put) AS data
         FROM running GROUP BY key),
state AS (SELECT key, CAST(m AS BIGINT) AS multiplicity, data FROM keys WHERE m > 0)
"""
_PROBES_SQL = "probes AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")).distinct()


@_query("ht_state", f"WITH {_LOG_SQL} SELECT key, multiplicity, data FROM state")
def ht_state(spark, sf_dir):
    return HashTable(_log(spark, sf_dir)).state()


@_query(
    "ht_size",
    f'WITH {_LOG_SQL} SELECT CAST(coalesce(sum(multiplicity), 0) AS BIGINT) AS size, count(*) AS "keys" FROM state',
)
def ht_size(spark, sf_dir):
    return HashTable(_log(spark, sf_dir)).size()


@_query("ht_is_empty", f"WITH {_LOG_SQL} SELECT count(*) = 0 AS is_empty FROM state")
def ht_is_empty(spark, sf_dir):
    return HashTable(_log(spark, sf_dir)).is_empty()


@_query("ht_search", f"WITH {_LOG_SQL}, {_PROBES_SQL} SELECT p.key, s.data FROM probes p LEFT JOIN state s ON p.key = s.key")
def ht_search(spark, sf_dir):
    return HashTable(_log(spark, sf_dir)).search(_probes(spark, sf_dir))


@_query(
    "ht_exist",
    f'WITH {_LOG_SQL}, {_PROBES_SQL} SELECT p.key, s.data IS NOT NULL AS "exists" '
    "FROM probes p LEFT JOIN state s ON p.key = s.key",
)
def ht_exist(spark, sf_dir):
    return HashTable(_log(spark, sf_dir)).exist(_probes(spark, sf_dir))


@_query(
    "ht_existing",
    f"WITH {_LOG_SQL}, {_PROBES_SQL} SELECT key FROM probes WHERE key IN (SELECT key FROM state WHERE data IS NOT NULL)",
)
def ht_existing(spark, sf_dir):
    return HashTable(_log(spark, sf_dir)).existing(_probes(spark, sf_dir))


@_query("ht_set_insert", "SELECT p_brand AS key, count(*) AS multiplicity, '1' AS data FROM part GROUP BY p_brand")
def ht_set_insert(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("key"))
    return HashTable.empty(spark).insert(rows).state()


@_query(
    "ht_remove",
    """WITH ins AS (SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1),
    del AS (SELECT p_brand AS key, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1)
    SELECT key, ins.n - coalesce(del.n, 0) AS multiplicity, '1' AS data FROM ins LEFT JOIN del USING (key)
    WHERE ins.n > coalesce(del.n, 0)""",
)
def ht_remove(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    put = part.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("key"))
    top = 1 << 40  # removes come after all inserts
    gone = part.where("p_size > 10").select((F.col("p_partkey") + top).alias("seq"), F.col("p_brand").alias("key"))
    return HashTable.empty(spark).insert(put).remove(gone).state()


@_query(
    "ht_normalized_keys",
    """WITH log AS (SELECT event_id AS seq, event_type IN ('click', 'view') AS put,
      CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || (user_id % 10) AS spelt,
      upper(event_type) || (user_id % 10) AS key, CAST(event_id AS VARCHAR) AS data FROM events),
    running AS (SELECT *, sum(CASE WHEN put THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY seq) AS s FROM log),
    keys AS (SELECT max_by(s, seq) - least(0, min(s)) AS m, arg_max_null(data, seq) FILTER (put) AS data,
      arg_max_null(spelt, seq) FILTER (put) AS key FROM running r GROUP BY r.key)
    SELECT key, CAST(m AS BIGINT) AS multiplicity, data FROM keys WHERE m > 0""",
)
def ht_normalized_keys(spark, sf_dir):
    spelt = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    log = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("click", "view"), "I").otherwise("R").alias("op"),
        F.concat(spelt, (F.col("user_id") % 10).cast("string")).alias("key"),
        F.col("event_id").cast("string").alias("data"),
    )
    return HashTable(log, key_normalizer=F.upper).state()


@_query(
    "ht_running_size",
    f"""WITH {_LOG_SQL}, kept AS (SELECT seq, put, key, s - least(0, min(s) OVER (PARTITION BY key ORDER BY seq)) AS m
      FROM running),
    changed AS (SELECT seq, put, m - coalesce(lag(m) OVER (PARTITION BY key ORDER BY seq), 0) AS d FROM kept)
    SELECT seq, CASE WHEN put THEN 'I' ELSE 'R' END AS op, CAST(sum(d) OVER (ORDER BY seq) AS BIGINT) AS n FROM changed""",
)
def ht_running_size(spark, sf_dir):
    return HashTable(_log(spark, sf_dir)).running_sizes()


def _capacity_sql(initial: int) -> str:
    return f"""SELECT CAST({initial} AS BIGINT) AS init_size, list_reduce(ops, lambda c, e:
      CASE WHEN e % 2 = 0 AND e // 2 >= c // 2 THEN c * 2
           WHEN e % 2 = 1 AND e // 2 > 0 AND e // 2 <= c // 8 THEN c // 2 ELSE c END,
      CAST({initial} AS BIGINT)) AS capacity FROM folded"""


@_query(
    "ht_capacity",
    f"""WITH {_LOG_SQL}, kept AS (SELECT seq, put, key, s - least(0, min(s) OVER (PARTITION BY key ORDER BY seq)) AS m
      FROM running),
    changed AS (SELECT seq, put, m - coalesce(lag(m) OVER (PARTITION BY key ORDER BY seq), 0) AS d FROM kept),
    total AS (SELECT seq, put, CAST(sum(d) OVER (ORDER BY seq) AS BIGINT) AS n FROM changed),
    folded AS (SELECT list(n * 2 + CASE WHEN put THEN 0 ELSE 1 END ORDER BY seq) AS ops FROM total)
    {_capacity_sql(997)} UNION ALL {_capacity_sql(2)}""",
)
def ht_capacity(spark, sf_dir):
    return HashTable(_log(spark, sf_dir)).capacities([997, 2])


@_query(
    "ht_cmp_key",
    """SELECT p_partkey, CAST(CASE WHEN encode(p_name) < encode(p_type) THEN -1 WHEN encode(p_name) > encode(p_type) THEN 1
      ELSE 0 END AS INTEGER) AS cmp FROM part""",
)
def ht_cmp_key(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(
        "p_partkey", paths.compare_keys(F.col("p_name"), F.col("p_type")).alias("cmp")
    )


# --- the persistent table ---------------------------------------------------


def _big_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a key that several share; the highest id is the last write."""
    key = F.concat_ws("/", F.col("lang"), F.col("source"), (F.col("doc_id") % 7).cast("string"))
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq"), key.alias("key"), F.col("text").alias("value"))


def _loaded(spark: SparkSession, sf_dir: str) -> BigTable:
    """A table with these rows; it goes when the program ends, after the result was read."""
    table = BigTable(spark, staging.new_path(spark))
    table.insert(_big_rows(spark, sf_dir))
    return table


_BIG_SQL = """WITH stored AS (SELECT concat_ws('/', lang, source, CAST(doc_id % 7 AS VARCHAR)) AS key,
  max_by(coalesce(text, ''), doc_id) AS value FROM documents GROUP BY 1),
probes AS (SELECT DISTINCT concat_ws('/', lang, source, CAST(doc_id % 9 AS VARCHAR)) AS key FROM documents)"""


def _big_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", F.col("lang"), F.col("source"), (F.col("doc_id") % 9).cast("string"))
    return _table(spark, sf_dir, "documents").select(key.alias("key")).distinct()


@_query(
    "big_reopen",
    f"""{_BIG_SQL}, n AS (SELECT count(*) AS keys FROM stored)
    SELECT 1 AS step, 'created' AS state, 0 AS keys UNION ALL SELECT 2, 'kept', keys FROM n
    UNION ALL SELECT 3, 'reopened', keys FROM n UNION ALL SELECT 4, 'added to', keys + 1 FROM n
    UNION ALL SELECT 5, 'deleted', 0""",
)
def big_reopen(spark, sf_dir):
    """A table that outlives its first user and goes with its second."""
    path, steps = staging.new_path(spark), []

    def note(state: str, table: BigTable | None) -> None:
        there = path_exists(spark, path)
        steps.append((len(steps) + 1, state, table.state().count() if table and there else 0))

    with BigTable(spark, path, keep=True) as table:
        note("created" if table.is_new else "found", table)
        table.insert(_big_rows(spark, sf_dir))
    note("kept", table)
    with BigTable(spark, path) as table:
        note("created" if table.is_new else "reopened", table)
        table.insert(spark.createDataFrame([("one/more", "value")], "key string, value string"))
        note("added to", table)
    note("there" if path_exists(spark, path) else "deleted", None)
    return spark.createDataFrame(steps, "step int, state string, keys long")


_FILTER_BITS = 1 << 14


@_query(
    "big_insert_get",
    f"""{_BIG_SQL} SELECT p.key, md5(value) AS value_md5, CAST(coalesce(octet_length(encode(value)), 0) AS INTEGER) AS value_size
    FROM probes p LEFT JOIN stored s ON p.key = s.key""",
)
def big_insert_get(spark, sf_dir):
    got = _loaded(spark, sf_dir).get(_big_probes(spark, sf_dir))
    return got.select("key", digests.md5_hex(F.col("value")).alias("value_md5"), "value_size")


@_query(
    "big_contains",
    f"{_BIG_SQL} SELECT p.key, s.key IS NOT NULL AS contained FROM probes p LEFT JOIN stored s ON p.key = s.key",
)
def big_contains(spark, sf_dir):
    return _loaded(spark, sf_dir).contains(_big_probes(spark, sf_dir))


@_query("big_containing", f"{_BIG_SQL} SELECT key FROM probes WHERE key IN (SELECT key FROM stored)")
def big_containing(spark, sf_dir):
    return _loaded(spark, sf_dir).containing(_big_probes(spark, sf_dir))


# --- the paged array --------------------------------------------------------


@_query(
    "listdb_set_get",
    """WITH stored AS (SELECT l_partkey AS idx, arg_max_null(lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 8, '0'),
      l_orderkey * 100 + l_linenumber) AS value FROM lineitem GROUP BY 1)
    SELECT p_partkey AS idx, value FROM part LEFT JOIN stored ON p_partkey = idx""",
)
def listdb_set_get(spark, sf_dir):
    value = F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 8, "0")
    seq = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    writes = _table(spark, sf_dir, "lineitem").select(seq.alias("seq"), F.col("l_partkey").alias("idx"), value.alias("value"))
    probes = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"))
    got = ListDB.empty(spark, unit_size=8).setvalue(writes).getvalue(probes)
    return got.select("idx", F.col("value").cast("string").alias("value"))


@_query(
    "listdb_reopen",
    """WITH stored AS (SELECT l_partkey AS idx, arg_max_null(lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 8, '0'),
      l_orderkey * 100 + l_linenumber) AS value FROM lineitem GROUP BY 1)
    SELECT p_partkey AS idx, CASE WHEN p_partkey <= 5 THEN '-swapped' ELSE value END AS value FROM part LEFT JOIN stored ON p_partkey = idx""",
)
def listdb_reopen(spark, sf_dir):
    """An array that is saved, opened again, held, and changed by operation code."""
    value = F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 8, "0")
    seq = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    writes = _table(spark, sf_dir, "lineitem").select(seq.alias("seq"), F.col("l_partkey").alias("idx"), value.alias("value"))
    path = staging.new_path(spark)
    ListDB.open(spark, path, 8).apply(VALUE_SET, writes).save(path)
    array = ListDB.open(spark, path, 8).cached()
    part = _table(spark, sf_dir, "part")
    late = part.where("p_partkey <= 5").select(F.lit(1).alias("seq"), F.col("p_partkey").alias("idx"), F.lit("-swapped").alias("value"))
    got = array.apply(VALUE_SET, late).apply(VALUE_GET, part.select(F.col("p_partkey").alias("idx")))
    return got.select("idx", F.col("value").cast("string").alias("value"))


# --- digests and checksums --------------------------------------------------


def _by_doc(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


def _folded(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    """The same for columns that fold every byte, which a whole row group in
    one task would be slow to do."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *[c.alias(n) for n, c in columns.items()])


@_query("md5_hex", "SELECT doc_id, md5(text) AS digest FROM documents")
def md5_hex(spark, sf_dir):
    return _by_doc(spark, sf_dir, digest=digests.md5_hex(F.col("text")))


@_query("md5_raw_hex", "SELECT doc_id, upper(md5(text)) AS digest, CAST(16 AS INTEGER) AS bytes FROM documents")
def md5_raw_hex(spark, sf_dir):
    raw = digests.md5_raw(F.col("text"))
    return _by_doc(spark, sf_dir, digest=digests.bytes_to_hex(raw), bytes=F.octet_length(raw))


@_query("md5_parts", "SELECT doc_id, md5(coalesce(lang, '') || coalesce(source, '') || coalesce(text, '')) AS digest FROM documents")
def md5_parts(spark, sf_dir):
    return _by_doc(spark, sf_dir, digest=digests.md5_parts(F.col("lang"), F.col("source"), F.col("text")))


@_query("bytes_to_hex", "SELECT p_partkey, hex(encode(p_name)) AS upper_hex, lower(hex(encode(p_name))) AS lower_hex FROM part")
def bytes_to_hex(spark, sf_dir):
    name = F.col("p_name")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", digests.bytes_to_hex(name).alias("upper_hex"), digests.bytes_to_hex(name, upper=False).alias("lower_hex")
    )


def _bytes_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"


def _fold_sql(text: str, start: str, step: str) -> str:
    return f"list_reduce({_bytes_sql(text)}, lambda h, c: {step}, CAST({start} AS BIGINT))"


_ADLER = "(h // 65536 + (h % 65536 + c) % 65521) % 65521 * 65536 + (h % 65536 + c) % 65521"
_RSYNC = "(h // 65536 + h % 65536 + c) % 65536 * 65536 + (h % 65536 + c) % 65536"


@_query("adler32", f"SELECT doc_id, {_fold_sql('text', '1', _ADLER)} AS checksum FROM documents")
def adler32(spark, sf_dir):
    return _folded(spark, sf_dir, checksum=checksums.adler32(F.col("text")))


@_query("adler32_rsync", f"SELECT doc_id, {_fold_sql('text', '0', _RSYNC)} AS checksum FROM documents")
def adler32_rsync(spark, sf_dir):
    return _folded(spark, sf_dir, checksum=checksums.adler32_rsync(F.col("text")))


@_query(
    "adler32_rolling",
    f"""WITH w AS (SELECT p_partkey, substr(p_name, 2, length(p_name) - 1) AS t FROM part)
    SELECT p_partkey, {_fold_sql("(t || 'x')", '0', _RSYNC)} AS rolled FROM w""",
)
def adler32_rolling(spark, sf_dir):
    """The window over a whole name, moved on by one byte, an ``x``."""
    name = F.col("p_name")
    rolled = checksums.adler32_rolling(
        checksums.adler32_rsync(name), F.octet_length(name).cast("bigint"), F.ascii(name).cast("bigint"), long(ord("x"))
    )
    return _table(spark, sf_dir, "part").select("p_partkey", rolled.alias("rolled"))


@_query(
    "adler32_all_windows",
    f"""WITH w AS (SELECT p_partkey, unnest(range(0, length(p_name) - 7)) AS i, p_name FROM part),
    cut AS (SELECT p_partkey, i, substr(p_name, i + 1, 8) AS t FROM w)
    SELECT p_partkey, CAST(i AS INTEGER) AS "at", {_fold_sql('t', '0', _RSYNC)} AS checksum FROM cut""",
)
def adler32_all_windows(spark, sf_dir):
    return checksums.rolling_checksums(_table(spark, sf_dir, "part"), "p_partkey", "p_name", 8)


# --- string hashes ----------------------------------------------------------

_M = "4294967295"
_TOP = f"((h << 4) & {_M}) + c"
_STEPS = {
    "bkdr": ("0", f"(h * 131 + c) & {_M}"),
    "bp": ("0", f"xor((h << 7) & {_M}, c)"),
    "djb": ("5381", f"(h * 33 + c) & {_M}"),
    "djb2": ("5381", f"xor((h * 33) & {_M}, c)"),
    "dek": ("octet_length(encode({0}))", f"xor(xor((h << 5) & {_M}, h >> 27), c)"),
    "elf": ("0", f"xor(({_TOP}) & {_M}, ((({_TOP}) & {_M}) >> 28) << 4) & 268435455"),
    "fnv": ("2166136261", f"xor((h * 16777619) & {_M}, c)"),
    "js": ("1315423911", f"xor(h, (((h << 5) & {_M}) + c + (h >> 2)) & {_M})"),
    "pjw": ("0", f"xor(({_TOP}) & {_M}, ((({_TOP}) & {_M}) >> 28) << 4) & 268435455"),
    "sdbm": ("0", f"(h * 65599 + c) & {_M}"),
}


def hash_sql(name: str, text: str) -> str:
    """The DuckDB expression of a hash."""
    if name == "ap":
        marked = f"list_transform({_bytes_sql(text)}, lambda c, i: c * 2 + (i - 1) % 2)"
        even = f"xor((h << 7) & {_M}, ((e // 2) * (h >> 3)) & {_M})"
        odd = f"xor((((h << 11) & {_M}) + xor(e // 2, h >> 5)) & {_M}, {_M})"
        return f"list_reduce({marked}, lambda h, e: xor(h, CASE WHEN e % 2 = 0 THEN {even} ELSE {odd} END), CAST(2863311530 AS BIGINT))"
    if name == "rs":
        wide = f"list_transform({_bytes_sql(text)}, lambda c: CAST(c AS HUGEINT))"
        step = f"((((s // 4294967296) * (s & {_M}) + c) & {_M}) * 4294967296) + (((s & {_M}) * 378551) & {_M})"
        return f"CAST(list_reduce({wide}, lambda s, c: {step}, CAST(63689 AS HUGEINT)) // 4294967296 AS BIGINT)"
    if name == "crc":
        bits = f"flatten(list_transform({_bytes_sql(text)}, lambda c: [c, 0, 0, 0, 0, 0, 0, 0]))"
        step = "xor(xor(h, c) >> 1, (xor(h, c) & 1) * 3988292384)"
        return f"xor(list_reduce({bits}, lambda h, c: {step}, CAST({_M} AS BIGINT)), {_M})"
    start, step = _STEPS[name]
    return _fold_sql(text, start.format(text), step)


def _hash_query(name: str):
    @_query(f"hash_{name}", f"SELECT c_custkey, {hash_sql(name, 'c_name')} AS hash FROM customer")
    def run(spark, sf_dir):
        return _table(spark, sf_dir, "customer").select("c_custkey", HASHES[name](F.col("c_name")).alias("hash"))


for _name in HASHES:
    _hash_query(_name)


@_query(
    "hash_documents",
    "SELECT doc_id, " + ", ".join(f"{hash_sql(n, 'text')} AS {n}" for n in ("ap", "js", "rs", "fnv")) + " FROM documents",
)
def hash_documents(spark, sf_dir):
    return _folded(spark, sf_dir, **{n: HASHES[n](F.col("text")) for n in ("ap", "js", "rs", "fnv")})


@_query(
    "ht_bucket",
    f"""WITH b AS (SELECT {hash_sql('rs', 'c_name')} % 997 AS bucket FROM customer)
    SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n FROM b GROUP BY 1""",
)
def ht_bucket(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(bucket(F.col("c_name"), 997).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


_FILTER_SQL = f"[{hash_sql('ap', 'key')} % {_FILTER_BITS}, {hash_sql('js', 'key')} % {_FILTER_BITS}]"


@_query(
    "big_may_contain",
    f"""{_BIG_SQL}, bits AS (SELECT DISTINCT unnest({_FILTER_SQL}) AS at FROM stored),
    asked AS (SELECT key, unnest({_FILTER_SQL}) AS at FROM probes)
    SELECT key, bool_and(b.at IS NOT NULL) AS may_contain FROM asked a LEFT JOIN bits b ON a.at = b.at GROUP BY key""",
)
def big_may_contain(spark, sf_dir):
    table = _loaded(spark, sf_dir)
    table.write_filter(_FILTER_BITS)
    return table.may_contain(_big_probes(spark, sf_dir))


# --- numbers, paths, file types ---------------------------------------------


@_query(
    "uint2str",
    """SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS digits,
      CAST(CASE WHEN o_custkey = 0 THEN 0 ELSE length(CAST(o_custkey AS VARCHAR)) END AS INTEGER) AS n,
      CASE WHEN o_custkey - 1 = 0 THEN '' ELSE CAST(o_custkey - 1 AS VARCHAR) END AS less FROM orders""",
)
def uint2str(spark, sf_dir):
    x = F.col("o_custkey")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", paths.uint2str(x).alias("digits"), paths.uint2str_length(x).alias("n"), paths.uint2str(x - 1).alias("less")
    )


@_query("file_ext", r"SELECT page_id, CASE WHEN instr(url, '.') > 0 THEN regexp_extract(url, '[^.]*$') END AS ext FROM pages")
def file_ext(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", paths.file_ext(F.col("url")).alias("ext"))


_NAMED = "CASE WHEN page_id % 3 = 0 THEN 'C:' || url WHEN page_id % 3 = 1 THEN '/' || url ELSE url END"


@_query(
    "target_path",
    f"""SELECT page_id, 'out/' || regexp_replace({_NAMED}, '^[\\x00-\\x7F]:', '') AS target,
      CAST(len(list_filter(string_split('out/' || regexp_replace({_NAMED}, '^[\\x00-\\x7F]:', ''), '/')[1:-2],
        lambda p: true)) AS INTEGER) AS depth FROM pages""",
)
def target_path(spark, sf_dir):
    path = paths.target_path(F.expr(_NAMED), F.lit("out"))
    return _table(spark, sf_dir, "pages").select(
        "page_id", path.alias("target"), F.size(paths.target_directories(path)).alias("depth")
    )


@_query("file_in_list", "SELECT doc_id, source IN ('src1', 'src3', 'SRC5') AS listed FROM documents")
def file_in_list(spark, sf_dir):
    return _by_doc(spark, sf_dir, listed=paths.in_list(F.col("source"), ["src1", "src3", "SRC5"]))


@_query(
    "file_in_table",
    "SELECT c_custkey FROM customer WHERE c_name IN (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') FROM orders)",
)
def file_in_table(spark, sf_dir):
    """Names that occur in another table, which may be of any length."""
    listed = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    names = _table(spark, sf_dir, "orders").select(listed.alias("c_name"))
    return paths.semi_list(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", names, "c_name").select("c_custkey")


@_query(
    "file_type",
    """SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE') THEN 'html' WHEN starts_with(html, '<html') THEN 'html'
      WHEN starts_with(html, '<?xml') THEN 'xml' END AS type FROM pages""",
)
def file_type(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", filetype.file_type(F.col("html")).alias("type"))


def _files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one text file for each nation; some begin like another type."""
    path = staging.new_path(spark)
    magic = F.when(F.col("n_nationkey") % 3 == 0, "%PDF-1.7 ").when(F.col("n_nationkey") % 3 == 1, "<!DOCTYPE html> ").otherwise("")
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(magic, "n_name").alias("value"))
    rows.write.partitionBy("n_nationkey").text(path)
    return path


_FILES_SQL = """files AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN '<!DOCTYPE html> ' ELSE '' END
  || n_name || chr(10) AS content FROM nation)"""


def _file_number() -> Column:
    return F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey")


@_query("file_digests", f"WITH {_FILES_SQL} SELECT n_nationkey, CAST(length(content) AS BIGINT) AS length, md5(content) AS md5 FROM files")
def file_digests(spark, sf_dir):
    found = files.file_digests(files.read_files(spark, _files(spark, sf_dir), "*.txt"))
    return found.select(_file_number(), "length", "md5")


@_query(
    "file_types",
    f"""WITH {_FILES_SQL} SELECT n_nationkey, 'txt' AS ext, CASE WHEN starts_with(content, '%PDF') THEN 'pdf'
      WHEN starts_with(content, '<!DOCTYPE') THEN 'html' END AS type FROM files""",
)
def file_types(spark, sf_dir):
    found = files.file_types(files.read_files(spark, _files(spark, sf_dir), "*.txt"))
    return found.select(_file_number(), "ext", "type")


@_query(
    "file_cleanup",
    "SELECT count(*) AS files, true AS removed, false AS there, false AS removed_again FROM nation",
)
def file_cleanup(spark, sf_dir):
    path = _files(spark, sf_dir)
    n = files.read_files(spark, path, "*.txt").count()
    row = n, files.remove_path(spark, path), files.path_exists(spark, path), files.remove_path(spark, path)
    staging.forget(path)
    return spark.createDataFrame([row], "files long, removed boolean, there boolean, removed_again boolean")


@_query("magic_map", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{t}')" for m, t in filetype.MAGIC.items()) + ") AS m(magic, type)")
def magic_map(spark, sf_dir):
    return spark.range(1).select(F.explode(filetype.magic_map()).alias("magic", "type"))


# --- duplicate elimination --------------------------------------------------


@_query(
    "dedup_exact",
    "SELECT md5(text) AS fingerprint, min(doc_id) AS canonical, count(*) AS refs FROM documents GROUP BY 1",
)
def dedup_exact(spark, sf_dir):
    return dedup.fingerprints(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query(
    "dedup_canonical_map",
    'SELECT doc_id AS "key", md5(text) AS fingerprint, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical FROM documents',
)
def dedup_canonical_map(spark, sf_dir):
    return dedup.canonical_map(_table(spark, sf_dir, "documents"), "doc_id", "text")


_CHUNKS_SQL = """chunks AS (SELECT doc_id AS "key", i AS chunk, h[i * 1024 + 1 : i * 1024 + 1024] AS content FROM
  (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, CAST(ceil(octet_length(encode(text)) / 512) AS BIGINT))) AS i
   FROM documents WHERE text IS NOT NULL))"""


@_query(
    "fixed_chunks",
    f'WITH {_CHUNKS_SQL} SELECT "key", CAST(chunk AS INTEGER) AS chunk, content AS content_hex FROM chunks',
)
def fixed_chunks(spark, sf_dir):
    chunks = dedup.fixed_chunks(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return chunks.select("key", "chunk", F.hex("content").alias("content_hex"))


@_query(
    "chunk_dedup_ratio",
    f"""WITH {_CHUNKS_SQL}, u AS (SELECT content, length(content) // 2 AS bytes, count(*) AS refs FROM chunks GROUP BY 1)
    SELECT CAST(sum(refs) AS BIGINT) AS chunks, CAST(sum(bytes * refs) AS BIGINT) AS bytes, count(*) AS unique_chunks,
      CAST(sum(bytes) AS BIGINT) AS unique_bytes FROM u""",
)
def chunk_dedup_ratio(spark, sf_dir):
    return dedup.chunk_savings(dedup.fixed_chunks(_table(spark, sf_dir, "documents"), "doc_id", "text"))


@_query(
    "two_level_match",
    """WITH first AS (SELECT doc_id AS "key", min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents)
    SELECT "key", canonical FROM first WHERE "key" <> canonical""",
)
def two_level_match(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return dedup.two_level_match(docs, "doc_id", "text", HASHES["crc"](F.col("text")))

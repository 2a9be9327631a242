"""The registered queries of the training-data operators.

Each ``opN_<name>(spark, sf_dir)`` applies its operator, with production
parameters, to a whole table and derives the digest columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import bpe, decontam, langid, lengths, secrets, urlfilter
from twinfold.llm.ann import nearest_neighbours
from twinfold.llm.frames import pick, ship
from twinfold.llm.neardup import near_duplicates
from twinfold.llm.sharding import shuffle_into_shards
from twinfold.llm.siteextract import extract_text
from twinfold.sources.tables import read_table, spread


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose every row is work for Python workers."""
    return spread(read_table(spark, sf_dir, name))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), k=10)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_spread(spark, sf_dir, "documents"), "source", "text")
    encoded = bpe.encode_documents(docs, *vocabulary())
    out = lengths.length_histogram(encoded.select("source", "n_tokens"), by=["source"])
    # what all documents come to when the context ends at this length
    return out.withColumn("tokens_truncated", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_spread(spark, sf_dir, "documents"), "doc_id", "text")
    encoded = bpe.encode_documents(docs, *vocabulary(), decode=True)
    return bpe.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(_spread(spark, sf_dir, "pages"), "page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A history of dated list entries, by rule from the hosts of a table.

    The tables hold no URL list, so one is made: hosts and their first path
    segments are added and removed on days that follow from their first page.
    """
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    name = urlfilter.host(F.col("url"))
    seen = pages.select(name.alias("host"), F.get(urlfilter.path_segments(F.col("url")), F.lit(0)).alias("top"), "page_id")
    seen = seen.where("host != '' AND page_id IS NOT NULL")
    hosts = seen.groupBy("host").agg(F.min("page_id").alias("p"))
    tops = seen.where("top IS NOT NULL").groupBy("host", "top").agg(F.min("page_id").alias("p"))
    first = F.pmod(F.col("p") * 17, F.lit(600))

    def entries(rows, listed, kind, pattern, when, shift, action):
        return rows.where(when).select(
            F.lit(listed).alias("list"),
            F.lit(kind).alias("kind"),
            pattern.alias("pattern"),
            day(first + shift).alias("listed_on"),
            F.lit(action).alias("action"),
        )

    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    return (
        entries(hosts, "hosts", "block", F.col("host"), F.col("p") % 3 != 2, 0, "add")
        .union(entries(hosts, "hosts", "block", F.col("host"), F.col("p") % 2 == 0, 90, "remove"))
        .union(entries(hosts, "hosts", "block", F.col("host"), F.col("p") % 4 == 0, 180, "add"))
        .union(entries(hosts, "domains", "block", parent, F.col("p") % 5 == 0, 30, "add"))
        .union(entries(tops, "sections", "allow", F.concat("host", F.lit("/"), "top"), F.col("p") % 2 == 1, 0, "add"))
        .union(entries(tops, "sections", "allow", F.concat("host", F.lit("/"), "top"), F.col("p") % 3 == 1, 60, "remove"))
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(read_table(spark, sf_dir, "pages"), "page_id", "url")
    # pages carry no fetch time; one follows from the id
    fetched = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 131, F.lit(730)).cast("int"))
    out = urlfilter.filter_urls(pages.withColumn("fetched_on", fetched), listed_hosts(pages))
    return out.withColumn("fetched_on", F.col("fetched_on").cast("string"))


OP5_SQL = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2023-01-01' + CAST((page_id * 131) % 730 AS INTEGER) AS DATE) AS fetched_on,
         regexp_replace(lower(regexp_extract(url, '{url}', 1)), '\.$', '') AS host,
         list_filter(string_split(replace(regexp_extract(url, '{url}', 2), '\\', '/'), '/'), lambda s: s <> '') AS segments,
         row_number() OVER () AS tag
  FROM pages),
hosts AS (SELECT host, min(page_id) AS p, (min(page_id) * 17) % 600 AS d FROM captures WHERE host <> '' GROUP BY host),
tops AS (SELECT host || '/' || segments[1] AS pattern, min(page_id) AS p, (min(page_id) * 17) % 600 AS d
         FROM captures WHERE host <> '' AND len(segments) > 0 GROUP BY 1),
entries AS (
  SELECT 'hosts' AS list, 'block' AS kind, host AS pattern, d AS day, false AS removed FROM hosts WHERE p % 3 <> 2
  UNION ALL SELECT 'hosts', 'block', host, d + 90, true FROM hosts WHERE p % 2 = 0
  UNION ALL SELECT 'hosts', 'block', host, d + 180, false FROM hosts WHERE p % 4 = 0
  UNION ALL SELECT 'domains', 'block', regexp_replace(host, '^[^.]+\.', ''), d + 30, false FROM hosts WHERE p % 5 = 0
  UNION ALL SELECT 'sections', 'allow', pattern, d, false FROM tops WHERE p % 2 = 1
  UNION ALL SELECT 'sections', 'allow', pattern, d + 60, true FROM tops WHERE p % 3 = 1),
days AS (SELECT list, kind, pattern, DATE '2023-01-01' + CAST(day AS INTEGER) AS listed_on, bool_or(removed) AS removed
         FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(listed_on) OVER (PARTITION BY list, kind, pattern ORDER BY listed_on) AS valid_to FROM days),
asked AS (
  SELECT tag, fetched_on, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(string_split(host, '.')[-n:], '.')),
    list_transform(range(1, len(segments) + 1), lambda n: host || '/' || array_to_string(segments[1:n], '/')))) AS pattern
  FROM captures WHERE host <> ''),
hits AS (
  SELECT tag, count(*) AS n, min(ROW(-length(a.pattern), kind, list, a.pattern)) AS b
  FROM asked a JOIN spans s ON a.pattern = s.pattern AND NOT removed
    AND fetched_on >= listed_on AND (valid_to IS NULL OR fetched_on < valid_to)
  GROUP BY tag)
SELECT page_id, url, CAST(fetched_on AS VARCHAR) AS fetched_on, coalesce(n, 0) AS n_active, b[4] AS decided_by, b[3] AS decided_list,
       coalesce(b[2] = 'block', false) AS blocked
FROM captures LEFT JOIN hits USING (tag)
""".replace("{url}", urlfilter.URL)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_spread(spark, sf_dir, "documents"), "doc_id", "text")
    out = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), longest=True)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "longest_words",
        F.coalesce("longest_at", F.lit(-1).cast("long")).alias("longest_at"),
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = r"""
WITH items AS (SELECT row_number() OVER () AS row, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({lower}, '{word}') AS w
               FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT *, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT row, item, k, unnest(range(1, len(w) - k + 2)) AS j,
                   unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS words FROM sized),
docs AS (SELECT doc_id, row_number() OVER () AS tag, coalesce(regexp_extract_all({lower}, '{word}'), []) AS w FROM documents),
cut AS (SELECT tag, k, range(1, len(w) - k + 2) AS starts, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS words
        FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
places AS (SELECT tag, k, unnest(starts) AS i, unnest(words) AS words FROM cut),
hits AS (SELECT tag, i, k, row, item, j FROM places JOIN windows USING (k, words)),
words AS (SELECT tag, count(DISTINCT j) AS n_hit FROM (SELECT tag, unnest(range(i, i + k)) AS j FROM hits) GROUP BY tag),
found AS (SELECT tag, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY tag),
runs AS (SELECT tag, i, k, row, i - j AS shift, i - row_number() OVER (PARTITION BY tag, row, i - j ORDER BY i) AS run FROM hits),
matches AS (SELECT tag, min(i) - 1 AS first, count(*) + any_value(k) - 1 AS n FROM runs GROUP BY tag, row, shift, run),
longest AS (SELECT tag, max(n) AS n, arg_max(first, n * 1000000000 - first) AS first FROM matches GROUP BY tag)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       CAST(coalesce(n, 0) AS BIGINT) AS longest_words, coalesce(CAST(first AS BIGINT), -1) AS longest_at
FROM docs LEFT JOIN words USING (tag) LEFT JOIN found USING (tag) LEFT JOIN longest USING (tag)
""".replace("{lower}", _LOWER).replace("{word}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_spread(spark, sf_dir, "documents"), "doc_id", "text")
    out = secrets.span_digests(secrets.scan_secrets(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(read_table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents")
    model = langid.learn(langid.training_rows(docs))
    held_out = F.coalesce(langid.fraction_of_crc(F.col("doc_id")) == 2, F.lit(False))
    out = langid.identify(pick(docs, "doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_spread(spark, sf_dir, "documents"), percent=85)


OP10_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
         FROM docs WHERE len(w) > 0),
one AS (SELECT s, min(doc_id) AS doc_id FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM one),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n + y.n) AS n
          FROM rows x JOIN rows y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM one UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
named AS (SELECT sets.doc_id, len(sets.s) AS n, component_id FROM sets JOIN one ON list_sort(sets.s) = one.s JOIN least ON one.doc_id = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM docs d LEFT JOIN named ON d.doc_id = named.doc_id
""".replace("{lower}", _LOWER)

QUERIES = {
    "op1_vantage_trees": op1_vantage_trees,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_html_extraction": op4_html_extraction,
    "op5_url_filters": op5_url_filters,
    "op6_decontamination": op6_decontamination,
    "op7_secrets": op7_secrets,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_minhash_neardup": op10_minhash_neardup,
}

#: The others are learned, drawn, approximate, or read bytes, markup or spans.
ORACLE_SQL: dict[str, str] = {
    "op5_url_filters": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op10_minhash_neardup": OP10_SQL,
}


def queries():
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__ = f.__name__
        return run

    return {name: shipped(f) for name, f in QUERIES.items()}

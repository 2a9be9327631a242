"""Every operator on tables whose extra columns clash by name, case or dots."""

import datetime

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinfold.llm import ann, bpe, decontam, langid, neardup, secrets, sharding, siteextract, urlfilter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ROWS = [(1, "hello token=abcdefgh1 text", 1, "x", "en", "s"), (2, None, 2, None, "en", "s"), (3, "", None, None, None, None)]
NAMES = [
    ["doc_id", "text", "TEXT", "a.b", "lang", "source"],
    ["doc_id", "text", "doc_id", "text", "lang", "source"],
    ["doc_id", "text", "Score", "ids", "lang", "source"],
]


def odd(spark, names):
    return spark.createDataFrame(ROWS, "a long, b string, c int, d string, e string, f string").toDF(*names)


@pytest.fixture(params=range(len(NAMES)))
def docs(request, spark):
    return odd(spark, NAMES[request.param])


def test_operators(spark, docs):
    bench = spark.createDataFrame([("i", "hello token")], "item_id string, text string")
    model = langid.learn(langid.training_rows(docs))
    outputs = [
        (bpe.encode_documents(docs, *VOCABULARY), 3),
        (decontam.decontaminate(docs, bench), 3),
        (decontam.remove_contaminated(docs, bench), 2),
        (secrets.scan_secrets(docs), 3),
        (secrets.redact_secrets(docs), 3),
        (langid.identify(docs, model), 3),
        (neardup.near_duplicates(docs), 3),
        (sharding.shuffle_into_shards(docs, 2), 3),
    ]
    for out, n in outputs:
        assert len(out.collect()) == n
    assert outputs[2][0].columns == outputs[4][0].columns == docs.columns


@pytest.mark.parametrize("name, apply", corpus_pipeline.STAGES)
def test_stages(spark, small, docs, name, apply):
    out = apply(spark, docs, small)
    out.collect()
    assert name == "encoding" or out.columns == docs.columns


def test_the_exact_name_wins_over_another_case(spark):
    """A column that differs in case only is no input, wherever it stands."""
    names = ["page_id", "HTML", "html", "URL", "url"]
    pages = spark.createDataFrame([(1, "<p>no", "<p>yes", "http://no.org", "http://yes.org")], "a int, b string, c string, d string, e string").toDF(*names)
    assert siteextract.extract_text(pages).first()["text"] == "yes"
    entries = spark.createDataFrame([("l", "block", "yes.org", "2020-01-01", "add")], "list string, kind string, pattern string, listed_on string, action string")
    captures = spark.createDataFrame([(1, None, datetime.date(2021, 1, 1), "http://no.org", "http://yes.org")], "a int, b date, c date, d string, e string")
    captures = captures.toDF("page_id", "FETCHED_ON", "fetched_on", "URL", "url")
    judged = urlfilter.filter_urls(captures, entries.withColumn("listed_on", F.col("listed_on").cast("date")))
    assert judged.first()["blocked"]


def test_pages_vectors_and_captures(spark):
    pages = spark.createDataFrame([(1, "http://a.org", "<p>x", 1)], "i long, u string, h string, e int").toDF("page_id", "url", "html", "HTML")
    assert siteextract.extract_text(pages).columns == ["page_id", "url", "html", "HTML", "text", "n_chars"]
    assert siteextract.extract_text(pages).first()["text"] == "x"
    vectors = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], "i long, e array<double>, x int").toDF("vec_id", "embedding", "VEC_ID")
    assert ann.nearest_neighbours(vectors).count() == 1
    lists = spark.createDataFrame([], "list string, kind string, pattern string, listed_on date, action string")
    captures = spark.createDataFrame([("http://a.org", None, "x")], "u string, d date, x string").toDF("url", "fetched_on", "Url")
    assert urlfilter.filter_urls(captures, lists).columns[:3] == ["url", "fetched_on", "Url"]

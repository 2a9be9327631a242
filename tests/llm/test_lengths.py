"""The length histogram against sums over the documents."""

import random
from collections import Counter

import pytest

from twinfold.llm import lengths
from twinfold.llm.queries import op2_token_counts, op3_byte_bpe


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 2, 5, 4095, 4096, 4097, 9000, None])) for _ in range(400)]
    return rows, spark.createDataFrame(rows, "g string, n_tokens long")


@pytest.mark.parametrize("by", [[], ["g"]])
def test_histogram(made, by):
    rows, frame = made
    groups = {}
    for g, n in rows:
        groups.setdefault(g if by else None, []).append(n or 0)
    hist = lengths.length_histogram(frame, by=by).cache()
    got = hist.collect()
    assert len(got) == sum(len(set(x)) for x in groups.values())
    for r in got:
        x = groups[r.g if by else None]
        n = r.n_tokens
        assert r.n_docs == Counter(x)[n]
        assert (r.docs_below, r.tokens_below) == (sum(y < n for y in x), sum(y for y in x if y < n))
        assert (r.docs_at_least, r.tokens_at_least) == (sum(y >= n for y in x), sum(y for y in x if y >= n))
    limits = [1, 3, 4096, 5000, 10**6]
    for r in lengths.truncated_totals(hist, limits, by=by).collect():
        x = groups[r.g if by else None]
        assert r.tokens_kept == sum(min(y, r.context) for y in x)
        assert r.docs_truncated == sum(y > r.context for y in x)
    quantiles = lengths.length_quantiles(hist, [0.01, 0.5, 1.0], by=by).collect()
    assert len(quantiles) == 3 * len(groups)
    for r in quantiles:
        x = sorted(groups[r.g if by else None])
        assert r.n_tokens == x[max(1, -(-int(r.share * 1000) * len(x) // 1000)) - 1]


def test_query(spark, small):
    want = {}
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source").collect()}
    for r in op3_byte_bpe(spark, small).collect():
        want.setdefault(sources[r.doc_id], []).append(r.n_tokens)
    for r in op2_token_counts(spark, small).collect():
        x = want[r.source]
        assert r.n_docs == x.count(r.n_tokens)
        assert r.tokens_truncated == sum(min(y, r.n_tokens) for y in x)


def test_empty(made):
    _, frame = made
    hist = lengths.length_histogram(frame.where("false"))
    assert hist.count() == 0
    assert lengths.truncated_totals(hist, [5]).count() == 0 and lengths.length_quantiles(hist, [0.5]).count() == 0


def test_other_columns_may_clash(made):
    rows, frame = made
    clashing = frame.selectExpr("g", "n_tokens", "1 AS a", "2 AS b", "3 AS c").toDF("g", "n_tokens", "N_TOKENS", "G", "a.b")
    hist = lengths.length_histogram(clashing, by=["g"])
    assert sorted(map(str, hist.collect())) == sorted(map(str, lengths.length_histogram(frame, by=["g"]).collect()))
    more = hist.selectExpr("*", "1 AS x", "2 AS y").toDF(*hist.columns, "DOCS_BELOW", "Context")
    assert lengths.truncated_totals(more, [3, 4096], by=["g"]).count() == 6
    assert lengths.length_quantiles(more, [0.5], by=["g"]).count() == 3

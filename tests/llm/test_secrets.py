"""Secret scans against the expressions run over every whole text."""

import hashlib
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinfold.llm import secrets
from twinfold.llm.queries import op7_secrets

ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def text_of(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def test_query(spark):
    small = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in op7_secrets(spark, small).collect()}
    total = 0
    for d in docs:
        want = base_spans(d["text"] or "")
        r = got[d["doc_id"]]
        total += len(want)
        counts = tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert (r.n_assign, r.n_access, r.n_hex) == counts
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
    assert total > 0


PARTS = st.sampled_from(
    ["password", "Secret", "TOKEN", "api_key", "apikey", "'", '"', " ", ":", "=", "abcd1234", "/x+=-_.", "AKIA", "ABCDEFGH12345678",
     "0123456789abcdef", "deadbeef" * 4, "é☃", "\n", "ſecret", "toKen", "ghp_", "a" * 36, "-----BEGIN ", "PRIVATE KEY-----"]
)


@settings(max_examples=500, deadline=None)
@given(texts=st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=4))
def test_any_texts(texts):
    found = secrets.find_spans(texts)
    assert [[s for s in spans if s[1] < 3] for spans in found] == [base_spans(t) for t in texts]
    # the index may not lose what a scan of everything finds
    for k, rule in enumerate(secrets.RULES):
        flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
        for t, spans in zip(texts, found, strict=True):
            whole = [m for m in re.finditer(rule.pattern, t, flags) if len(m[rule.group]) >= rule.least]
            assert [s for s in spans if s[1] == k] == [(m.start(), k, m.end()) for m in whole]


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_trigrams_are_mandatory(rule):
    query = secrets.trigram_query(rule.pattern)
    assert (query is True) == (rule.kind == "hex")


def test_redaction(spark, odd_documents):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [(1, f"x {key} y"), (2, "clean"), (3, None), (4, f"token={key}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert got == {1: "x [secret] y", 2: "clean", 3: None, 4: "[secret]"}
    assert sorted(map(str, secrets.redact_secrets(odd_documents).collect())) == sorted(map(str, odd_documents.collect()))


BODY = "\n".join("Ab0+/xyZ" * 8 for _ in range(5))


@pytest.mark.parametrize(
    "key, rest",
    [
        (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F1E\n\n{BODY}\nAb0=\n-----END RSA PRIVATE KEY-----", "\nmore text"),
        (f"-----BEGIN PRIVATE KEY-----\n{BODY}\nAb0+x\n-----END PRIVATE KEY-----", " - and more"),
        ("-----BEGIN EC PRIVATE KEY-----\\n" + BODY.replace("\n", "\\n") + "\\n-----END EC PRIVATE KEY-----", '\\n"}'),
        (f"-----BEGIN PRIVATE KEY-----\n{BODY}\nAb0+x", "\nThe text goes on in sentences."),
        (f"-----BEGIN OPENSSH PRIVATE KEY-----\n{BODY}", ""),
    ],
)
def test_no_byte_of_a_private_key_stays(spark, key, rest):
    docs = spark.createDataFrame([(1, f"before {key}{rest}")], "doc_id long, text string")
    assert secrets.redact_secrets(docs).first().text == f"before [secret]{rest}"


def test_many_headers_take_linear_time():
    began = time.time()
    secrets.find_spans(["-----BEGIN PRIVATE KEY-----\n" * 20_000, "-----BEGIN PRIVATE KEY----- " + "ab cd " * 200_000])
    assert time.time() - began < 20


@pytest.mark.parametrize(
    "pattern, query",
    [
        ("a{2}bc", {"aab", "abc"}),
        ("[^a]bcd", {"bcd"}),
        ("x(?=y)abc", {"xab", "abc"}),
        (r"(?:a|b)cde?", {"acd", "bcd", "cde"}),
        (r"\d+@foo\.com", {"@fo", "foo", "oo.", "o.c", ".co", "com"}),
        ("abc|", set()),
        ("(?i)abc", set()),
        (r"(abc)\1", set()),
        ("(?P<n>abc)", set()),
    ],
)
def test_reader_of_expressions(pattern, query):
    """What is not known gives no trigram, so every document is scanned."""
    assert secrets.trigrams_of(secrets.trigram_query(pattern)) == query


def test_odd_documents(spark, odd_documents):
    out = secrets.scan_secrets(odd_documents.withColumnRenamed("score", "Secret_Spans"))
    assert out.columns == ["doc_id", "text", "lang", "secret_spans"]
    assert [r.secret_spans for r in out.collect()] == [[]] * 8
    assert secrets.scan_secrets(odd_documents.where("false")).count() == 0


def test_long_text(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ab ☃") for _ in range(300_000)) + " " + "0123456789abcdef" * 2
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = secrets.span_digests(secrets.scan_secrets(docs)).first()
    assert r.spans == text_of(base_spans(text)) and r.n_hex == 1

"""Byte-level BPE against the tokenizer library, and the round trip."""

import base64
import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from twinfold.llm import bpe
from twinfold.llm.queries import op3_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.codec(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    data = codec.encode(text)
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=120))
def test_any_text(codec, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(codec, text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet="abeht \n'.sS1é", max_size=200))
def test_texts_of_few_letters(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 3000, "ab" * 4000, "<|endoftext|>", "é" * 999, "\x00\x01", "don't  stop\n\n x"])
def test_stated_texts(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)


def test_long_texts(codec, library, monkeypatch):
    monkeypatch.setattr(bpe.BytePairCodec, "LONG", 10)
    for text in ("plain words and 123 numbers " * 20, "größere Wörter ☃ " * 20):
        assert ids(codec, text) == library.encode_ordinary(text)


def test_every_character(codec, library):
    text = "".join(chr(i) + " x" for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for at in range(0, len(text), 300_000):
        assert ids(codec, text[at : at + 300_000]) == library.encode_ordinary(text[at : at + 300_000])


def test_query(spark, small, library):
    got = {r.doc_id: r for r in op3_byte_bpe(spark, small).collect()}
    rows = pq.read_table(f"{small}/documents.parquet").to_pylist()
    assert len(got) == len(rows)
    for row in rows:
        text = row["text"] or ""
        want = library.encode_ordinary(text)
        data = b"".join(i.to_bytes(4, "little") for i in want)
        r = got[row["doc_id"]]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(data).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_documents(spark, odd_documents):
    out = bpe.encode_documents(odd_documents.withColumnRenamed("score", "IDS"), PATH, public_tokenizers.PATTERN, decode=True)
    assert out.columns == ["doc_id", "text", "lang", "n_tokens", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == 8 and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[2] == 0
    assert bpe.encode_documents(odd_documents.where("false"), PATH, public_tokenizers.PATTERN).count() == 0

"""Language identification: held-out accuracy, and the filter itself."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from twinfold.llm import langid
from twinfold.llm.queries import op9_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d["doc_id"]: d for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = op9_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id]["lang"]]
    assert sum(r.lang_pred == docs[r.doc_id]["lang"] for r in held) >= 0.97 * len(held)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, k) for i in range(20) for t, k in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    rows += [(90, None, "en"), (91, "", "de")]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_filter_has_all_languages_of_an_ngram(model):
    assert model.languages == ["de", "en"]
    both = model.containing(langid.gram_keys("the hund"))[0]
    assert ((both & np.uint64(3)) > 0).all()
    assert model.decide("the dog and the cat")[0] == "en" and model.decide("die katze")[0] == "de"
    assert model.decide("THE DOG") == model.decide("the dog")
    for text in (None, "", "123 ... !", " \n"):
        assert model.decide(text) == ("und", 0.0)
    assert model.decide("ωψξ") == ("de", 0.0)  # letters, but of no language: the smaller name


def test_long_texts_are_read_whole(model, monkeypatch):
    text = "the cat " * 400 + "der hund und " * 900
    whole = sorted(langid.gram_keys(text))
    monkeypatch.setattr(langid, "_PIECE", 100)
    assert sorted(langid.gram_keys(text)) == whole
    assert model.decide(text)[0] == "de"


def plain_grams(text):
    """The n-grams of a whole text as strings, by walking over its words."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(f" {word} ")
            word = ""
    return [w[i : i + n] for n in langid.ORDERS for w in words for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("piece", [10, 37, 100])
def test_no_ngram_is_lost_at_a_cut(monkeypatch, piece):
    """Scripts without spaces, where a cut falls inside a word, and a capital
    whose small form depends on what follows."""
    rng = np.random.default_rng(piece)
    han = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 400, 500))
    for text in (han, han[:57] + " ab, " + han[57:], "ΑΣΒΣ" * 40, "a" * 101, "ab " * 80, "x", "", "İstanbul " * 20):
        monkeypatch.setattr(langid, "_PIECE", 1 << 20)
        whole = sorted(langid.gram_keys(text))
        assert len(whole) == len(plain_grams(text)) and len(set(whole)) == len(set(plain_grams(text)))
        monkeypatch.setattr(langid, "_PIECE", piece)
        assert sorted(langid.gram_keys(text)) == whole


def test_filter_against_exact_sets(spark):
    """Shares and decisions of the filter against sets of n-grams counted in plain Python."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    train = [d for d in docs if d["lang"] and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2]
    rows = {k: [set(plain_grams(d["text"] or "")) for d in train if d["lang"] == k] for k in sorted({d["lang"] for d in train})}
    counts = {k: {} for k in rows}
    for k, found in rows.items():
        for s in found:
            for g in s:
                counts[k][g] = counts[k].get(g, 0) + 1
    share = {k: {g: n / len(rows[k]) for g, n in c.items() if n >= min(3, len(rows[k])) and n / len(rows[k]) >= 0.002} for k, c in counts.items()}
    exact = {k: {g for g, x in c.items() if x >= 0.3 * max(o.get(g, 0) for o in share.values())} for k, c in share.items()}
    model = langid.learn(spark.createDataFrame([(d["doc_id"], d["text"], d["lang"]) for d in train], "doc_id long, text string, lang string"))
    assert model.languages == sorted(rows)
    for d in docs[::7]:
        grams = plain_grams(d["text"] or "")
        if grams:
            want = np.array([sum(g in exact[k] for g in grams) / len(grams) for k in model.languages])
            got = model.shares(langid.gram_keys(d["text"]))
            assert np.abs(got - want).max() < 0.1
            assert got.argmax() == want.argmax() or np.sort(want)[-1] - np.sort(want)[-2] < 0.1


def test_more_languages_than_bytes(spark, monkeypatch):
    """Fewer positions for many languages, and no upper number of them."""
    monkeypatch.setattr(langid, "FILTER_BYTES", 1 << 16)
    rows = [(k, f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)}", f"l{k:04}") for k in range(1500)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 1500 and model.masks.shape == (24, 4096)
    assert sum(model.decide(t)[0] == n for _, t, n in rows[::50]) >= 20


def test_odd_documents(spark, odd_documents, model):
    out = langid.identify(odd_documents, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == 8
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 5, 6)} == dict.fromkeys((1, 2, 5, 6), "und")
    kept = langid.keep_identified(odd_documents, model)
    assert kept.columns == odd_documents.columns and not {1, 2, 5, 6} & {r.doc_id for r in kept.collect()}
    empty = langid.learn(langid.training_rows(odd_documents.where("false")))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd_documents, empty).collect()} == {("und", 0.0)}


def test_many_languages(spark):
    """More than one word of bits."""
    names = [f"l{i:03}" for i in range(130)]
    rows = [(k * 3 + j, f"{chr(0x4E00 + 50 * k)}{chr(0x4E01 + 50 * k)} {chr(0x4E02 + 50 * k)}", n) for k, n in enumerate(names) for j in range(3)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.masks.shape[0] == 3
    assert all(model.decide(t)[0] == n for _, t, n in rows)

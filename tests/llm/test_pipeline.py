"""The pipeline against its stages done by brute force."""

import base64
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_decontam import brute as hits
from tests.llm.test_neardup import brute as groups
from tests.llm.test_neardup import shingles
from twinfold.llm import neardup, secrets
from twinfold.sources import staging


def masked(text):
    out, done = [], 0
    for a, _, b in secrets.find_spans([text])[0]:
        if a >= done:
            out += [text[done:a], "[secret]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def test_run(spark, small):
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    docs = {i: t for i, t in docs.items() if t and any(map(str.isalpha, t))}
    docs = {i: docs[i] for i, _, _, kept in groups(list(docs.items()), 80) if kept}
    bench = [(str(b["item_id"]), b["text"]) for b in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    found = hits(list(docs.values()), bench, 10)
    docs = {i: masked(t) for (i, t), (_, hit, _) in zip(docs.items(), found, strict=True) if not hit}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = set(staging._staged)
    rows = corpus_pipeline.run(spark, small).collect()
    assert len(set(staging._staged) - before) == 1  # what the last stage reads
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.n_tokens == len(ids) and r.round_trip


@pytest.mark.parametrize("name, apply", corpus_pipeline.STAGES)
def test_stages_take_odd_documents(spark, small, odd_documents, name, apply):
    out = apply(spark, odd_documents.withColumn("source", odd_documents.lang), small)
    if name != "encoding":
        assert out.columns == [*odd_documents.columns, "source"]
    assert out.count() <= 8
    assert apply(spark, odd_documents.where("false").withColumn("source", odd_documents.lang), small).count() == 0


def test_one_of_repeated_rows_stays(spark, small, odd_documents):
    kept = corpus_pipeline.near_dedup(spark, odd_documents, small).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 5, 6]


def test_different_texts_of_one_id_stay(spark, small):
    """Copies go by their text, in whatever order the hashes of the texts are."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(3, text(0)), (-2, text(1)), (1, text(1)), (None, text(2)), (None, text(3)), (None, text(1))]
    rows += [(5, text(0)), (5, text(0) + " more"), *[(5, text(n)) for n in range(4, 14)], (5, text(4)), (5, text(4) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text.removesuffix(" more")) for r in corpus_pipeline.near_dedup(spark, docs, small).collect()]
    want = [(3, text(0)), (-2, text(1)), (None, text(2)), (None, text(3)), *[(5, text(n)) for n in range(4, 14)]]
    assert sorted(got, key=str) == sorted(want, key=str)


def row_by_row(rows, percent):
    """Which rows stay, by comparing all pairs: of each group the smallest id
    (then any), of equal rows one, and every row without words."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (sets[a] and 100 * both >= percent * len(sets[a] | sets[b])) or rows[a] == rows[b]:
                up[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i])
    return [{r for r in g if (r[0] is None, r[0]) == min((x[0] is None, x[0] or 0) for x in g) or r[0] == min((x[0] for x in g if x[0] is not None), default=None)} for g in groups.values()]


@pytest.mark.parametrize("few, most_bits", [(1000, 64), (0, 1 << 27), (0, 64)])
def test_near_dedup_row_by_row(spark, small, monkeypatch, few, most_bits):
    """Equal ids of different texts, ids of which one row is a copy, null ids;
    by the keys themselves, by a filter that knows the rows to go, and by one
    that is too small to know anything."""
    monkeypatch.setattr(neardup, "FEW_KEYS", few)
    monkeypatch.setattr(neardup, "MOST_FILTER_BITS", most_bits)
    rng = random.Random(most_bits)
    word = lambda n: f"w{n}x{rng.randrange(30)}"
    texts = [" ".join(word(n) for _ in range(40)) for n in range(12)]
    texts += [t + " " + t.split()[0] for t in texts[:6]] + ["", None, "one two"]
    rows = [(rng.choice([None, *range(8)]), rng.choice(texts)) for _ in range(120)]
    rows += [(3, "b " * 9), (5, "a " * 9), (5, "b " * 9), (7, "c " * 9), (7, "d " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, small).collect()]
    want = row_by_row(rows, 80)
    assert len(got) == len(want)
    left = list(got)
    for group in want:
        chosen = [r for r in left if r in group]
        assert len(chosen) == 1
        left.remove(chosen[0])


def test_stages_are_the_stated_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "encoding"]

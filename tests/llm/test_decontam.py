"""Decontamination against a search of every window in every document."""

import hashlib
import random
import re

import pyarrow.parquet as pq

from twinfold.llm import decontam
from twinfold.llm.queries import op6_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if names := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


def brute_longest(text, items, window):
    """``(words, place, {(item, place in it)})`` of the longest match by trying all pairs of places."""
    w, best = words(text), {}
    for name, other in items:
        v = words(other)
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n >= min(window, len(v)):
                    best.setdefault((-n, i), set()).add((name, j))
    if not best:
        return 0, None, {(None, None)}
    n, i = min(best)
    return -n, i, best[n, i]


def test_query(spark, small):
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    items = pq.read_table(f"{small}/benchmark.parquet").to_pylist()
    want = brute([d["text"] for d in docs], [(str(i["item_id"]), i["text"]) for i in items], 10)
    got = {r.doc_id: r for r in op6_decontamination(spark, small).collect()}
    assert sum(h > 0 for _, h, _ in want) > 0
    for d, (n, hit, found) in zip(docs, want, strict=True):
        r = got[d["doc_id"]]
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert tuple(r)[1:6] == (n, hit, len(found), digest, hit > 0)
        longest = brute_longest(d["text"], [(str(i["item_id"]), i["text"]) for i in items], 10)[:2] if hit else (0, -1)
        assert (r.longest_words, r.longest_at) == longest


def test_random_texts(spark):
    """Few words, so that windows repeat, overlap and meet at document ends."""
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(["a", "b", "C", "dé"]) + rng.choice(["", ",", "."]) for _ in range(n))
    docs = [make(rng.randint(0, 60)) for _ in range(60)] + [None, "", "...", "ein Wort"]
    items = [(str(i), make(rng.randint(0, 12))) for i in range(25)] + [("99", None), ("98", "?!"), ("3", make(9))]
    want = brute(docs, items, 4)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for chunk in (8 << 20, 20):
        got = decontam.decontaminate(frame, bench, window=4, chunk_bytes=chunk, shard_rows=17).collect()
        assert [(r.n_words, r.n_hit, r["items"]) for r in sorted(got)] == want
        more = decontam.decontaminate(frame, bench, window=4, chunk_bytes=chunk, shard_rows=17, longest=True).collect()
        for r in more:
            n, at, places = brute_longest(docs[r.doc_id], items, 4)
            assert (r.longest_words, r.longest_at) == (n, at) and (r.longest_item, r.longest_item_at) in places
    clean = decontam.remove_contaminated(frame, bench, window=4).collect()
    assert sorted(r.doc_id for r in clean) == [i for i, (_, hit, _) in enumerate(want) if not hit]


def test_rounds_of_a_large_benchmark(spark, monkeypatch):
    """Items in many rounds of few chunks, with columns that clash."""
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice(["a", "b", "c"]) for _ in range(n))
    docs = [make(rng.randint(0, 40)) for _ in range(40)] + [None, "", "..."]
    items = [(str(i), make(rng.randint(0, 9))) for i in range(12)] + [("99", None)]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(docs)], "doc_id long, text string, c int, d string")
    frame = frame.toDF("doc_id", "text", "Items", "TEXT")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = decontam.decontaminate(frame, bench, window=5, longest=True).collect()
    matches = decontam.longest_matches(frame, bench, least=4).collect()
    monkeypatch.setattr(decontam, "MOST_CHUNKS", 2)
    out = decontam.decontaminate(frame, bench, window=5, longest=True, chunk_bytes=20, shard_rows=17)
    assert out.columns[:3] == ["doc_id", "text", "TEXT"] and out.columns[3:] == decontam.decontaminate(frame, bench, longest=True).columns[3:]
    plain = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated, r.longest_words, r.longest_at) for r in rows)
    assert plain(out.collect()) == plain(whole)
    assert sorted(decontam.longest_matches(frame, bench, least=4, chunk_bytes=20).collect()) == sorted(matches)
    clean = decontam.remove_contaminated(frame, bench, window=5, chunk_bytes=20)
    assert clean.columns == frame.columns
    assert sorted(r[0] for r in clean.collect()) == sorted(r.doc_id for r in whole if not r.n_hit)


def test_chunks_are_built_once(monkeypatch):
    """A worker builds the chunks it keeps once, the others once for each slice."""
    built = []
    make = decontam.Suffixes.of
    monkeypatch.setattr(decontam.Suffixes, "of", lambda items, window: built.append(items) or make(items, window))
    monkeypatch.setattr(decontam, "KEPT_CHUNKS", 2)
    decontam._suffixes.clear()

    class Chunk:
        def __init__(self, i):
            self.value = f"chunk {i}", [(str(i), f"{'ab' * i} b c d e f".encode())]

    chunks = [Chunk(i) for i in range(1, 6)]
    for _ in range(10):
        found = decontam._shard_rows([b"x abab b c d e f", b"b c d e"], decontam._load(chunks, 4))
        assert found.longest.tolist() == [6, 4] and found.item[0] == "2" and found.items[0] == set("12345")
    assert len(built) == 2 + 10 * 3


def test_longest_matches(spark):
    docs = spark.createDataFrame([(7, "x a b c d y"), (3, "z a b c q"), (9, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a b c d e")], "item_id string, text string")
    got = decontam.longest_matches(docs, bench, least=3).orderBy("item_word").collect()
    assert [tuple(r) for r in got] == [("i", 0, 4, 7, 1), ("i", 1, 3, 7, 2)]


def test_odd_documents(spark, odd_documents):
    bench = spark.createDataFrame([("i", "the same words here again"), (None, "word " * 12)], "item_id string, text string")
    out = decontam.decontaminate(odd_documents.withColumnRenamed("score", "Items"), bench)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "n_hit", "items", "contaminated"]
    rows = out.collect()
    assert len(rows) == 8
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows if r.doc_id == 3] == [(30_000, 30_000, [""])]
    assert [(r.n_hit, r["items"]) for r in rows if r.doc_id == 4] == [(5, ["i"])] * 2
    assert decontam.decontaminate(odd_documents.where("false"), bench).count() == 0
    assert decontam.decontaminate(odd_documents, bench.where("false")).where("contaminated").count() == 0

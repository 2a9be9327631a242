"""Benchmark decontamination with training suffix arrays.

The words of each shard of documents that a benchmark uses at all form runs;
a suffix array over the starts of those runs' suffixes is sorted by prefix
doubling. Every benchmark suffix is then binary-searched in it. The neighbours
of its place give its longest verbatim match, and the range that shares its
first words gives all the places where its window occurs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from twinfold.llm.frames import add_columns, pick, position, same_columns, slices, stage, tidy, unstage

#: Bytes of text that one suffix array covers at most.
SHARD_BYTES = 4 << 20
#: Lower-cases A-Z and blanks every byte that is not of a word.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs of 0-9, a-z (A-Z lower-cased) and non-ASCII."""
    return text.translate(_TABLE).split()


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at ``starts`` by their first ``depth`` words.

    ``tokens`` ends every run with a 0, which sorts first and ends a suffix.
    Ranks are doubled: by 1, 2, 4, ... words.
    """
    rank = np.zeros(len(tokens) + 1, dtype=np.int64)
    rank[starts] = tokens[starts]
    covered = 1
    order = np.argsort(rank[starts], kind="stable")
    while covered < depth:
        second = rank[np.minimum(starts + covered, len(tokens))]
        key = rank[starts] * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rank[starts[order]] = fresh
        covered *= 2
        if fresh[-1] == len(starts):
            break
    return starts[order]


class _Numbers(dict):
    """Numbers words from 1 in the order they are first met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


@dataclass
class Suffixes:
    """The suffixes of some benchmark items over a vocabulary of word numbers.

    ``tokens`` holds the items one after another with a 0 after each;
    ``starts`` are the suffixes, ``left`` the words each has, ``window`` how
    many of them make its window (0: too few, or an earlier suffix has the
    same), ``item`` whose they are and ``first`` where in the item they begin.
    ``order`` lists the suffixes as they sort, ``size`` is the number of words
    of a full window. ``sharers`` are the items that
    have the window of a suffix.
    """

    vocabulary: dict[bytes, int]
    tokens: np.ndarray
    starts: np.ndarray
    left: np.ndarray
    window: np.ndarray
    item: np.ndarray
    first: np.ndarray
    order: np.ndarray
    size: int
    ids: list[str]
    _begin: dict[int, tuple[int, int]]
    _items: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int) -> Suffixes:
        vocabulary, parts, ids = _Numbers(), [np.zeros(0, np.int64)], []
        for name, text in items:
            if found := words(text):
                parts += [np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)), np.zeros(1, np.int64)]
                ids.append(name)
        tokens = np.concatenate(parts)
        zero = np.flatnonzero(tokens == 0)
        lengths = np.diff(zero, prepend=-1) - 1
        starts = np.flatnonzero(tokens)
        item = np.repeat(np.arange(len(ids)), lengths)
        left = zero[item] - starts
        first = lengths[item] - left
        size = np.minimum(window, lengths)[item]
        depth = int(left.max()) if len(left) else 1
        order = np.searchsorted(starts, suffix_array(tokens, starts, depth)) if len(starts) else starts
        # suffixes with one window stand together among those that have one
        full = order[left[order] >= size[order]]
        same = np.zeros(len(full), bool)
        if len(full):
            same[1:] = size[full[1:]] == size[full[:-1]]
            for i in range(window):
                on = np.flatnonzero(same & (i < size[full]))
                same[on] = tokens[starts[full[on]] + i] == tokens[starts[full[on - 1]] + i]
        begin = np.flatnonzero(~same)
        named = np.minimum.reduceat(full, begin) if len(full) else full
        windows = np.zeros(len(starts), np.int64)
        windows[named] = size[named]
        ends = np.append(begin, len(full))[1:]
        group = dict(zip(named.tolist(), zip(begin.tolist(), ends.tolist(), strict=True), strict=True))
        return cls(dict(vocabulary), tokens, starts, left, windows, item, first, order, window, ids, group, item[full])

    def sharers(self, suffix: int) -> set[str]:
        a, b = self._begin[suffix]
        return {self.ids[i] for i in self._items[a:b].tolist()}


class Shard:
    """Suffix array of one shard of documents against one set of suffixes."""

    def __init__(self, docs: list[list[int | None]], bench: Suffixes):
        # word numbers, 0 for a word no item has and after each document
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.begin = np.cumsum(sizes + 1) - (sizes + 1)
        flat: list[int] = []
        for d in docs:
            flat += d
            flat.append(0)
        self.tokens = np.array(flat, dtype=np.int64)
        self.bench = bench
        zero = np.flatnonzero(self.tokens == 0)
        runs = np.diff(zero, prepend=-1)  # words of the run that each 0 ends, and the 0
        wanted = bench.window[bench.window > 0]
        self.least = int(wanted.min()) if len(wanted) else 1
        # a run shorter than the shortest window holds no occurrence
        starts = np.flatnonzero(np.repeat(runs > self.least, runs) & (self.tokens > 0))
        self.depth = int(bench.left.max()) if len(bench.left) else 1
        self.order = suffix_array(self.tokens, starts, self.depth) if len(starts) else starts

    def _common(self, at: np.ndarray, which: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Common prefix of training suffixes and benchmark suffixes, in words."""
        n = np.zeros(len(at), dtype=np.int64)
        going = np.flatnonzero(limit > 0)
        a, b = self.tokens, self.bench.tokens
        while len(going):
            same = a[at[going] + n[going]] == b[self.bench.starts[which[going]] + n[going]]
            going = going[same]
            n[going] += 1
            # a 0 ends both, and no benchmark word is 0 within its limit
            going = going[n[going] < limit[going]]
        return n

    def bound(self, which: np.ndarray, limit: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of benchmark suffixes by their first ``limit`` words."""
        lo = np.zeros(len(which), dtype=np.int64)
        hi = np.full(len(which), len(self.order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            at, w = self.order[mid], which[open_]
            n = self._common(at, w, limit[open_])
            whole = n >= limit[open_]
            mine = self.tokens[at + np.where(whole, 0, n)]
            other = self.bench.tokens[self.bench.starts[w] + np.where(whole, 0, n)]
            before = np.where(whole, upper, mine < other)
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each benchmark suffix the length and place of its longest match."""
        which, limit = np.arange(len(self.bench.starts)), self.bench.left
        length, place = np.zeros(len(which), np.int64), np.full(len(which), -1, np.int64)
        if len(self.order):
            at = self.bound(which, limit, False)
            for neighbour in (at - 1, at):
                ok = np.flatnonzero((neighbour >= 0) & (neighbour < len(self.order)))
                found = self.order[neighbour[ok]]
                n = self._common(found, which[ok], limit[ok])
                better = n > length[ok]
                length[ok[better]], place[ok[better]] = n[better], found[better]
        return length, place

    def first_of(self, which: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all places that share the first ``length`` words of a suffix the
        one in the document of least rank, and there the first: document and word."""
        if not len(which):
            return which, which
        low, high = self.bound(which, length, False), self.bound(which, length, True)
        doc = np.searchsorted(self.begin, self.order, side="right") - 1
        key = (rank[doc] << 32) + self.order - self.begin[doc]
        key = np.append(key, np.iinfo(np.int64).max)
        least = np.minimum.reduceat(key, np.column_stack([low, high]).ravel())[::2]
        return np.argsort(rank)[least >> 32], least & 0xFFFFFFFF

    def longest_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of its longest match with a benchmark
        suffix, and which suffix that is."""
        bench = self.bench
        lo, hi = np.zeros(len(place), np.int64), np.full(len(place), len(bench.order), np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            which, at = bench.order[mid], place[open_]
            n = self._common(at, which, bench.left[which])
            before = bench.tokens[bench.starts[which] + n] < self.tokens[at + n]
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        length, suffix = np.zeros(len(place), np.int64), np.full(len(place), -1, np.int64)
        for neighbour in (lo - 1, lo):
            ok = np.flatnonzero((neighbour >= 0) & (neighbour < len(bench.order)))
            which = bench.order[neighbour[ok]]
            n = self._common(place[ok], which, bench.left[which])
            better = n > length[ok]
            length[ok[better]], suffix[ok[better]] = n[better], which[better]
        return length, suffix

    def windows(self):
        """Occurrences of the distinct windows: suffixes and places."""
        which = np.flatnonzero(self.bench.window > 0)
        if not len(which) or not len(self.order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        limit = self.bench.window[which]
        low, high = self.bound(which, limit, False), self.bound(which, limit, True)
        n = high - low
        suffix = np.repeat(which, n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return suffix, self.order[np.repeat(low, n) + offset]


@dataclass
class Found:
    """What one shard's documents have in common with the benchmark.

    For each document its words, its hit words, which words these are (begin
    and end of each run of them), the items found, and its longest verbatim match: words, the word of the document where it begins,
    the item and the word of the item (0, -1, "", -1 without one).
    """

    n_words: np.ndarray
    n_hit: np.ndarray
    covered: list[np.ndarray]
    items: list[set[str]]
    longest: np.ndarray
    at: np.ndarray
    item: list[str]
    item_at: np.ndarray


def _shard_rows(docs: list[bytes], chunks) -> Found:
    """Hold a shard of documents against all chunks of items."""
    split = [words(d) for d in docs]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    hit_marks = np.zeros(int((sizes + 1).sum()) + 1, dtype=np.int64)
    n = len(docs)
    none = np.full(n, -1, np.int64)
    out = Found(sizes, sizes, [], [set() for _ in docs], np.zeros(n, np.int64), none, [""] * n, none.copy())
    for bench in chunks:
        known = bench.vocabulary.get
        shard = Shard([[known(w, 0) for w in s] for s in split], bench)
        suffix, place = shard.windows()
        np.add.at(hit_marks, place, 1)
        np.add.at(hit_marks, place + bench.window[suffix], -1)
        doc = np.searchsorted(begin, place, side="right") - 1
        width = max(1, len(bench.starts))
        for pair in np.unique(doc * width + suffix).tolist():
            out.items[pair // width] |= bench.sharers(pair % width)
        # a match long enough to count begins with a window: of that many words
        # or more, or all of a shorter item
        by_size = np.lexsort((suffix, -bench.window[suffix], place))
        place, first = np.unique(place[by_size], return_index=True)
        short = suffix[by_size[first]]
        length, suffix = shard.longest_at(place)
        whole = length < bench.size
        length[whole], suffix[whole] = bench.window[short[whole]], short[whole]
        doc = np.searchsorted(begin, place, side="right") - 1
        for i in np.lexsort((place, -length, doc))[np.searchsorted(np.sort(doc), np.unique(doc))].tolist():
            d = int(doc[i])
            at = place[i] - begin[d]
            if length[i] > out.longest[d] or (length[i] == out.longest[d] and at < out.at[d]):
                out.longest[d], out.at[d] = length[i], at
                out.item[d], out.item_at[d] = bench.ids[bench.item[suffix[i]]], bench.first[suffix[i]]
    hit = np.cumsum(hit_marks)[:-1] > 0
    hits = np.concatenate(([0], np.cumsum(hit)))
    out.n_hit = hits[begin + sizes] - hits[begin] if n else sizes
    # no run crosses a document's end, as the 0 there is never hit
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    cuts = np.searchsorted(edges, np.append(begin, len(hit)))
    out.covered = [edges[cuts[i] : cuts[i + 1]] - begin[i] for i in range(n)]
    return out


#: Chunks of items whose suffixes a worker keeps for its next slices and tasks.
KEPT_CHUNKS = 4
_suffixes: dict[tuple[str, int], Suffixes] = {}


#: Chunks that are broadcast at once. A larger benchmark takes several rounds.
MOST_CHUNKS = 16


def _rounds(benchmark: DataFrame, id_col: str, chunk_bytes: int):
    """Lists of broadcasts, of as many chunks of items as are broadcast at once.

    A chunk has at most ``chunk_bytes`` of text (or one item) and a name of its
    own. The driver streams the items, so it holds one chunk at a time; there
    is always a first list.
    """
    sc = benchmark.sparkSession.sparkContext
    rows = pick(benchmark, id_col, "text").where(F.col("text").isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    out, part, size = [], [], 0
    for row in rows.toLocalIterator():
        if size and size + len(row.text) > chunk_bytes:
            out.append(sc.broadcast((uuid.uuid4().hex, part)))
            part, size = [], 0
            if len(out) == MOST_CHUNKS:
                yield out
                out = []
        part.append((row.item or "", bytes(row.text)))
        size += len(row.text)
    yield [*out, sc.broadcast((uuid.uuid4().hex, part))]


def _load(chunks, window: int):
    """The suffixes of each chunk. The first few stay for the next slices; of
    a larger benchmark only the others are built again for each slice."""
    names = {b.value[0] for b in chunks[:KEPT_CHUNKS]}
    for key in [k for k in _suffixes if k[0] not in names or k[1] != window]:
        del _suffixes[key]
    for b in chunks:
        name, items = b.value
        found = _suffixes.get((name, window)) or Suffixes.of(items, window)
        if name in names:
            _suffixes[name, window] = found
        yield found


def _judge(chunks, window: int):
    """A function from texts to what they have in common with the benchmark."""

    def judge(texts) -> Found:
        raw = texts.cast(pa.binary()).to_pylist()
        return _shard_rows([t or b"" for t in raw], _load(chunks, window))

    return judge


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    chunk_bytes: int = 4 << 20,
    shard_rows: int = 8192,
) -> DataFrame:
    """The rows without a match of the benchmark, with the columns they came with.

    A row goes if its longest verbatim match has ``window`` words, or is all
    of a shorter item. Null and empty texts have no words and stay, as does
    every row if the benchmark is empty; repeated rows stay or go together,
    very long texts are read whole, and an empty table stays empty.

    A benchmark of more than ``MOST_CHUNKS`` chunks takes several rounds, each
    over what the one before kept and wrote down.
    """

    def clean(docs, chunks):
        def begin():
            judge = _judge(chunks, window)
            return lambda part, at: part.filter(pa.array(judge(part.column(at)).longest == 0, pa.bool_()))

        return same_columns(docs, begin, most_rows=shard_rows, most_bytes=SHARD_BYTES)

    names, written = docs.columns, None
    rounds = _rounds(benchmark, "item_id", chunk_bytes)
    chunks = next(rounds)
    for following in rounds:
        kept = stage(clean(docs, chunks).toDF(*[f"_{i}" for i in range(len(names))]))
        if written is not None:
            unstage(written)
        for b in chunks:
            b.destroy()
        docs, written, chunks = kept.toDF(*names), kept, following
    return clean(docs, chunks)


_LONGEST = [*[StructField(f"longest_{c}", LongType()) for c in ("words", "at", "item_at")], StructField("longest_item", StringType())]


def _longest_columns(got: Found) -> list[list]:
    found = (got.longest > 0).tolist()
    placed = [[int(x) if f else None for x, f in zip(c, found, strict=True)] for c in (got.at, got.item_at)]
    return [got.longest.tolist(), *placed, [i if f else None for i, f in zip(got.item, found, strict=True)]]


def _in_rounds(texts: DataFrame, rounds, window: int, shard_rows: int) -> DataFrame:
    """``(tag, n_hit, items, longest_...)`` of those rows ``(tag, text)`` that
    have a match, by several rounds over them, each of which writes down what
    it found."""
    schema = StructType(
        [
            StructField("tag", LongType()),
            StructField("covered", ArrayType(LongType())),
            StructField("items", ArrayType(StringType())),
            *_LONGEST,
        ]
    )
    arrow = to_arrow_schema(schema)

    def search(chunks):
        def work(batches):
            judge = _judge(chunks, window)
            for part in slices(batches, most_rows=shard_rows, most_bytes=SHARD_BYTES):
                got = judge(part.column(1))
                columns = [part.column(0).to_pylist(), [c.tolist() for c in got.covered], [sorted(i) for i in got.items]]
                columns += _longest_columns(got)
                found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                yield found.filter(pa.array(got.longest > 0, pa.bool_()))

        return work

    parts = []
    for chunks in rounds:
        parts.append(stage(texts.mapInArrow(tidy(search(chunks)), schema)))
        for b in chunks:
            b.destroy()
    every = reduce(DataFrame.union, parts)
    zero = F.lit(0).cast("long")
    # begins and ends alternate: pairs, sorted, give the words that any round covers
    pairs = F.array_sort(F.flatten(F.collect_list(F.transform(
        F.filter("covered", lambda _, i: i % 2 == 0),
        lambda x, i: F.struct(x.alias("a"), F.get("covered", i * 2 + 1).alias("b")),
    ))))
    union = F.aggregate(
        "pairs",
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda s, p: F.struct(
            (s["n"] + F.greatest(zero, p["b"] - F.greatest(s["end"], p["a"]))).alias("n"), F.greatest(s["end"], p["b"]).alias("end")
        ),
        lambda s: s["n"],
    )
    names = [f.name for f in _LONGEST]
    best = F.max_by(F.struct(*names), F.struct("longest_words", -F.col("longest_at")))
    merged = every.groupBy("tag").agg(
        pairs.alias("pairs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("best")
    )
    return merged.select("tag", union.alias("n_hit"), "items", *[f"best.{n}" for n in names])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    chunk_bytes: int = 4 << 20,
    shard_rows: int = 8192,
    longest: bool = False,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` and ``contaminated`` to every row.

    A word is hit if it lies in an occurrence of a window: ``window``
    consecutive words of an item, or all words of a shorter one. ``items`` are
    the distinct ids, sorted as strings, of the items with an occurring
    window (a null id counts as the empty string). With ``longest`` come
    ``longest_words``, the words of the document's longest verbatim match (0 if
    it has no window), and the place of it: from word ``longest_at`` of the
    document and word ``longest_item_at`` of ``longest_item`` on; of equally
    long ones the first in the document. Null and empty texts have
    no words, so they hit nothing and no item without words is found; repeated
    documents and repeated items are each judged alike. Clashing input columns
    are replaced, others pass through; empty tables give no rows or no hits.

    A benchmark of more than ``MOST_CHUNKS`` chunks is searched in rounds, so
    what is broadcast at once is bounded; the documents are then written down
    with a number, and what the rounds found is joined to them.
    """
    rounds = _rounds(benchmark, "item_id", chunk_bytes)
    chunks, following = next(rounds), next(rounds, None)
    added = [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField("contaminated", BooleanType()),
        *_LONGEST * longest,
    ]

    def begin(chunks):
        judge = _judge(chunks, window)

        def columns(texts):
            got = judge(texts)
            out = [got.n_words, got.n_hit, [sorted(i) for i in got.items], got.longest > 0]
            return out + _longest_columns(got) * longest

        return columns

    if following is None:
        return add_columns(docs, added, lambda: begin(chunks), most_rows=shard_rows, most_bytes=SHARD_BYTES)
    # a tag that a second run could draw differently is written down
    tagged = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]).withColumn("tag", F.monotonically_increasing_id())
    tagged = stage(tagged.withColumn("text", F.col(f"_{position(docs, 'text')}").cast("string")))
    found = _in_rounds(tagged.select("tag", "text"), chain([chunks, following], rounds), window, shard_rows)
    count = lambda texts: [[len(words(t or b"")) for t in texts.cast(pa.binary()).to_pylist()]]
    joined = add_columns(tagged, added[:1], lambda: count).join(found, "tag", "left")
    taken = {f.name.lower() for f in added}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in taken]
    out = joined.select(
        *[F.col(f"_{i}") for i in kept],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        *[F.coalesce("longest_words", F.lit(0).cast("long")).alias("longest_words"), *[f.name for f in _LONGEST[1:]]] * longest,
    )
    return out.toDF(*[docs.columns[i] for i in kept], *[f.name for f in added])


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, least: int = 10, chunk_bytes: int = 4 << 20, shard_rows: int = 8192
) -> DataFrame:
    """The longest verbatim match of every benchmark suffix over all shards.

    One row ``(item_id, item_word, n_words, doc_id, doc_word)`` for each item
    and word where a match of at least ``least`` words begins; of equally long
    matches the smallest ``(doc_id, doc_word)`` counts. Each shard sends one
    row for each suffix at most, whatever its documents hold. Null and empty
    texts have no words, items of one id are one item, repeated documents
    change nothing, empty tables give no rows, other columns are ignored.
    """
    out = "item_id string, item_word long, n_words long, doc_id long, doc_word long"

    def search(batches, chunks):
        for part in slices(batches, most_rows=shard_rows, most_bytes=SHARD_BYTES):
            ids = part.column(0).to_pylist()
            split = [words(t or b"") for t in part.column(1).to_pylist()]
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
            for bench in _load(chunks, least):
                known = bench.vocabulary.get
                shard = Shard([[known(w, 0) for w in s] for s in split], bench)
                length, _ = shard.longest()
                good = np.flatnonzero(length >= least)
                doc, word = shard.first_of(good, length[good], rank)
                first = bench.first[good]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bench.ids[i] for i in bench.item[good]], pa.string()),
                        pa.array(first, pa.int64()),
                        pa.array(length[good], pa.int64()),
                        pa.array([ids[d] for d in doc.tolist()], pa.int64()),
                        pa.array(word, pa.int64()),
                    ],
                    names=["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                )

    rows = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    best = F.max(F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("doc_word")).alias("w")))
    parts, rounds = [], _rounds(benchmark, "item_id", chunk_bytes)
    found = lambda chunks: rows.mapInArrow(tidy(partial(search, chunks=chunks)), out)
    chunks = next(rounds)
    for following in rounds:
        parts.append(stage(found(chunks)))
        for b in chunks:
            b.destroy()
        chunks = following
    return (
        reduce(DataFrame.union, [*parts, found(chunks)])
        .groupBy("item_id", "item_word")
        .agg(best.alias("b"))
        .select("item_id", "item_word", "b.n_words", (-F.col("b.d")).alias("doc_id"), (-F.col("b.w")).alias("doc_word"))
    )

"""Near-duplicates: banded MinHash, odd sketches, and exact confirmation.

Every distinct word sequence gets MinHash samples. Bands of samples put
similar sequences into common buckets. The samples are also folded into a
parity bitmap (an odd sketch), and the population count of the XOR of two
bitmaps estimates their similarity closely where it is high. Within a bucket
the sketches connect what may be similar; whole sets confirm every link inside
the groups that result.

Exact copies are one node from the start. Groups are searched breadth first:
a member is compared with those not reached yet, so a group of n near copies
costs about n comparisons and emits n - 1 links. Larger groups are dealt out in
blocks, and only what the blocks leave apart is compared across them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from twinfold.llm.components import connected_components
from twinfold.llm.frames import pick, position, power_of_two, scope, slices, stage, tidy, unstage

SHINGLE = 5
BANDS, ROWS, SKETCH_SAMPLES, SKETCH_BITS = 24, 5, 128, 512
#: Members of a bucket, and shingles of a group, that one task compares at once;
#: a member of a group weighs as many shingles beside its own, so that a block
#: has few members however short they are.
BUCKET_BLOCK, GROUP_BLOCK, MEMBER_WEIGHT = 512, 1_000_000, 200
#: Keys that are few enough to be broadcast; for more there is a filter of so
#: many bits for each, and at most.
FEW_KEYS, BITS_PER_ID, MOST_FILTER_BITS = 200_000, 16, 1 << 27

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(971))
_WORD_MULT = _rng.integers(1, 2**63, SHINGLE, dtype=_U) * _U(2) + _U(1)
_SAMPLE_XOR = _rng.integers(0, 2**32, SKETCH_SAMPLES, dtype=np.uint32)
_SAMPLE_MULT = _rng.integers(0, 2**31, SKETCH_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_MULT = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=_U) * _U(2) + _U(1)
_BAND_ADD = _rng.integers(1, 2**63, BANDS, dtype=_U)
_BIT_MULT = _rng.integers(1, 2**63, SKETCH_SAMPLES, dtype=_U) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Words(dict):
    """64-bit hashes of words, with a bound on how many are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _forget() -> None:
    _words.clear()


def split_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; runs of anything but ASCII space and \\t to \\r."""
    return text.lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles.

    Fewer words make one shingle of the whole sequence; none make none.
    """
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    if n < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=n)], _U)
    w = np.fromiter(map(_words.__getitem__, words), _U, n)
    m = n - SHINGLE + 1
    h = w[:m] * _WORD_MULT[0]
    for i in range(1, SHINGLE):
        h += w[i : m + i] * _WORD_MULT[i]
    h = np.sort(_mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def min_samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash: for each sample the least 32-bit value over the set."""
    short = (hashes >> _U(32)).astype(np.uint32)
    best = np.full(SKETCH_SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        x = short[None, at : at + 2048] ^ _SAMPLE_XOR[:, None]
        x *= _SAMPLE_MULT[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best


def signature(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and the odd sketch of a non-empty set."""
    best = min_samples(hashes).astype(_U)
    rows = best[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = _mix((rows * _BAND_MULT).sum(axis=1, dtype=_U) + _BAND_ADD)
    bits = _mix(best * _BIT_MULT + _BIT_MULT) >> _U(64 - (SKETCH_BITS.bit_length() - 1))
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return keys.view(np.int64), np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_similarity(differing: np.ndarray) -> np.ndarray:
    """Estimated similarity from the population count of an XOR."""
    share = np.minimum(2 * differing / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS / (4 * SKETCH_SAMPLES) * np.log(1 - share)


def _signatures(batches):
    """``(doc_id, node, n_shingles, bands, sketch)``; node names the words."""
    for part in slices(batches, most_rows=1024, most_bytes=4 << 20):
        ids, texts = part.column(0), part.column(1).to_pylist()
        done: dict[bytes, tuple] = {}
        rows = []
        for text in texts:
            words = split_words(text or b"")
            if not words:
                rows.append((None, 0, None, None))
                continue
            node = xxhash.xxh128_digest(b" ".join(words))
            if node not in done:
                hashes = shingle_set(words)
                done[node] = (node, len(hashes), *signature(hashes))
            rows.append(done[node])
        node, n, bands, sketch = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(node, pa.binary()),
                pa.array(n, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(sketch, pa.binary()),
            ],
            names=["doc_id", "node", "n_shingles", "bands", "sketch"],
        )


def _groups(batches, n_keys: int):
    """Runs of rows with equal first ``n_keys`` columns, as lists of columns.

    The rows must come sorted by those columns. One group is held at a time.
    """
    held, key = [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        n, at = batch.num_rows, 0
        keys = list(zip(*columns[:n_keys], strict=True)) if n else []
        while at < n:
            end = at + 1
            while end < n and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                if held:
                    yield key, held
                held, key = [[] for _ in columns[n_keys:]], keys[at]
            for have, more in zip(held, columns[n_keys:], strict=True):
                have += more[at:end]
            at = end
    if held:
        yield key, held


def _search(n: int, linked) -> list[tuple[int, int]]:
    """``(member, first)`` for each member but the first of what is connected,
    by breadth-first search; ``linked(x, others)`` says which of the others x
    is linked with."""
    rest, stars = np.arange(n), []
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        queue = [first]
        while queue and len(rest):
            x = queue.pop()
            mask = linked(x, rest)
            found = rest[mask].tolist()
            stars += [(y, first) for y in found]
            queue += found
            rest = rest[~mask]
    return stars


def _edges(pairs):
    return pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"]
    )


def _by_sketch(percent: int, slack: float):
    """Who may be similar, by sizes and by the sketches of a group's members."""
    least = percent / 100 - slack

    def make(n, sketches):
        bits = np.frombuffer(b"".join(sketches), _U).reshape(len(n), -1)
        size = np.array(n)

        def linked(x, others):
            close = np.minimum(size[others], size[x]) * 100 >= percent * np.maximum(size[others], size[x])
            differing = np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1, dtype=np.int64)
            return close & (sketch_similarity(differing) >= least)

        return linked

    return make


def _by_set(percent: int):
    """Who is similar, by the whole sets of a group's members.

    Sets are held against each other only if they share one of the shingles
    that come first when the rare ones do: similar sets must. So members that
    share no more than what all of the group share cost next to nothing.
    """

    def make(_, contents):
        sets = [np.frombuffer(c, _U) for c in contents]
        size = np.array([len(x) for x in sets])
        joined, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        # numbers in the order of frequency, so that a sorted set begins with its rarest
        rank = np.empty(len(counts), np.int32)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
        joined = rank[joined]
        ends = np.cumsum(size)
        parts = [np.sort(joined[e - k : e]) for e, k in zip(ends, size, strict=True)]
        # one more than may be missing from a set that is similar to this one
        first = size - (size * percent + 99) // 100 + 1
        rare = np.concatenate([p[:k] for p, k in zip(parts, first, strict=True)])
        order = np.argsort(rare, kind="stable")
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), first)[order]
        begin = np.searchsorted(rare[order], np.arange(len(counts) + 1))
        flag, shares = np.zeros(len(counts), bool), np.zeros(len(sets), bool)

        def linked(x, others):
            holders = [owner[begin[t] : begin[t + 1]] for t in parts[x][: first[x]].tolist()]
            for h in holders:
                shares[h] = True
            mask = shares[others] & (np.minimum(size[others], size[x]) * 100 >= percent * np.maximum(size[others], size[x]))
            for h in holders:
                shares[h] = False
            near = others[mask]
            if len(near):
                flag[parts[x]] = True
                flat = np.concatenate([parts[i] for i in near])
                begins = np.cumsum(size[near]) - size[near]
                shared = np.add.reduceat(flag[flat], begins, dtype=np.int64)
                flag[parts[x]] = False
                mask[mask] = 100 * shared >= percent * (size[near] + size[x] - shared)
            return mask

        return linked

    return make


def _within(make, key_type: pa.DataType):
    """``(key, a, b)``: members of each block of a group, and the smallest node
    that the links inside the block join them with. Nodes come in order."""

    def batch(found):
        columns = [pa.array([f[0] for f in found], key_type)]
        columns += [pa.array([f[i] for f in found], pa.binary()) for i in (1, 2)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b"])

    def work(batches):
        found = []
        for (key, _), (node, n, data) in _groups(batches, 2):
            if len(node) > 1:
                found += [(key, node[x], node[first]) for x, first in _search(len(node), make(n, data))]
            if len(found) > 20_000:
                yield batch(found)
                found = []
        yield batch(found)

    return work


def _across(make):
    """Links from the asking rows of a cell to the others with another label,
    one for each label at most."""

    def work(batches):
        for _, (node, n, data, label, asks) in _groups(batches, 3):
            linked, pairs = make(n, data), []
            code = np.unique(np.array(label, dtype=object), return_inverse=True)[1]
            asking = np.array(asks)
            others = np.flatnonzero(~asking)
            for x in np.flatnonzero(asking).tolist():
                rest = others[code[others] != code[x]]
                if len(rest):
                    hit = rest[linked(x, rest)]
                    pairs += [(node[x], node[y]) for y in hit[np.unique(code[hit], return_index=True)[1]].tolist()]
            yield _edges(pairs)

    return work


def _few(keys: DataFrame) -> bool:
    return keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS


def _filter_bits(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes ``h``, of bounded size, as 64-bit words.

    The driver gets a row for each word at most. Beyond the bound the filter
    lets more through, which the joins after it drop.
    """
    bits = min(MOST_FILTER_BITS, power_of_two(max(1 << 12, BITS_PER_ID * wanted.count())))
    mask = F.lit(bits - 1).cast("long")
    place = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
    words = (
        wanted.select(place.alias("at"))
        .groupBy(F.shiftrightunsigned("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, _U)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(_U)
    return out


def _in_filter(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    h = h.view(_U)
    out = np.ones(len(h), bool)
    for at in (h, h >> _U(32)):
        at = at & _U(len(bits) * 64 - 1)
        out &= (bits[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)
    return out


def _sets(shared):
    """``(node, content)`` of the rows ``(h, text)``, of those whose hash is in
    the filter if there is one: the whole shingle set, as packed hashes."""

    def work(batches):
        for batch in batches:
            some = batch.filter(pa.array(_in_filter(batch.column(0).to_numpy(), shared.value))) if shared else batch
            for part in slices([some], most_rows=512, most_bytes=4 << 20):
                split = [split_words(t or b"") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh128_digest(b" ".join(w)) for w in split], pa.binary()),
                        pa.array([shingle_set(w).tobytes() for w in split], pa.binary()),
                    ],
                    names=["node", "content"],
                )

    return work


def _links(rows: DataFrame, totals: DataFrame, block: int, weight: Column, make, held: list[DataFrame]) -> DataFrame:
    """Links that join what the links inside each group join: ``(a, b)``.

    ``rows`` are ``(key, members, node, n, data)``, members being the sum of
    ``weight`` over the group, and ``totals`` has a row for each group; ``make``
    tells which rows of a group are linked. Groups of one block are searched in
    one task. A larger group is dealt into blocks, and what they join is named
    by labels. One row of each label is compared again; after that one label
    usually has almost all. Every row of any other label is then held against
    all rows of its group, in cells of two blocks, so no link between two
    labels is lost, and a group of n copies costs n comparisons rather than n
    squared. ``held`` gets the staged tables that can be deleted once the links
    have been read.
    """
    key = rows.schema["key"].dataType
    sized = rows.withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def inside(frame: DataFrame) -> DataFrame:
        dealt = frame.select("key", "own", "node", "n", "data").repartition("key", "own")
        work = tidy(_within(make, to_arrow_type(key)))
        return dealt.sortWithinPartitions("key", "own", "node").mapInArrow(work, f"key {key.simpleString()}, a binary, b binary")

    found = inside(sized.where("blocks = 1")).select("a", "b")
    if totals.where(F.col("members") > block).isEmpty():
        return found
    large = stage(sized.where("blocks > 1").drop("members"))
    stars = stage(inside(large).withColumnRenamed("a", "node"))
    large = stage(large.join(stars, ["key", "node"], "left").withColumn("label", F.coalesce("b", "node")).drop("b"))
    # the row that a label is named after stands for it
    named = large.where("node = label").drop("own")
    parts = stage(named.groupBy("key").agg(F.ceil(F.sum(weight) / block).cast("int").alias("parts")))
    again = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    more = stage(inside(named.join(parts, "key").withColumn("own", again)).withColumnRenamed("a", "label"))
    rows = large.join(more, ["key", "label"], "left").withColumn("label", F.coalesce("b", "label")).drop("b")
    rows = stage(rows)
    sizes = rows.groupBy("key", "label").agg(F.sum(weight).alias("size"))
    main = F.max_by("label", F.struct("size", "label")).alias("main")
    asking = (1 - F.max("size") / F.sum("size")).alias("asking")
    left = stage(sizes.groupBy("key").agg(main, asking).where("asking > 0"))
    held += [large, stars, parts, more, rows, left]
    rows = rows.join(left, "key").withColumn("parts", F.ceil(F.col("asking") * F.col("blocks")).cast("int"))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    cell = ["key", "part", "own", "node", "n", "data", "label", "asks"]
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asks = rows.where("label != main").withColumn("part", part).withColumn("own", upto("blocks"))
    others = rows.withColumn("part", upto("parts"))
    cells = asks.withColumn("asks", F.lit(True)).select(cell).union(others.withColumn("asks", F.lit(False)).select(cell))
    dealt = cells.repartition("key", "part", "own").sortWithinPartitions("key", "part", "own")
    apart = dealt.mapInArrow(tidy(_across(make)), "a binary, b binary")
    return found.union(stars.select("node", "b")).union(more.select("label", "b")).union(apart)


def near_duplicates(docs: DataFrame, percent: int = 85, slack: float = 0.17, id_type: str = "long") -> DataFrame:
    """Components of documents that share ``percent`` of their shingles.

    One row ``(doc_id, n_shingles, component_id, kept)`` for each input row.
    Documents are linked if 100 * intersection >= percent * union of their
    5-word shingle sets; ``component_id`` is the smallest doc_id reachable.
    Null and empty texts, and texts without words, have no shingles and are
    linked with nothing: each is its own component. Repeated rows and ids are
    rows like any other. Null ids name nothing: such a row takes the smallest
    other id of its component, else null, and is kept only in the latter case.
    Other columns are ignored; an empty table gives an empty result.

    ``slack`` is how far below ``percent`` a sketch's estimate may lie before
    the pair is dropped unconfirmed: five standard deviations. ``id_type`` is
    what ids are cast to; any type with an order will do.
    """
    with scope() as keep:
        return _near_duplicates(docs, percent, slack, id_type, keep)


def _near_duplicates(docs: DataFrame, percent: int, slack: float, id_type: str, keep) -> DataFrame:
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast(id_type), F.col("text").cast("binary").alias("text"))
    signature_of = f"doc_id {id_type}, node binary, n_shingles long, bands array<long>, sketch binary"
    signed = keep(stage(source.mapInArrow(tidy(_signatures, _forget), signature_of)))
    some = signed.where("node IS NOT NULL")
    # one row for each distinct word sequence
    nodes = stage(
        some.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
    )
    in_bands = nodes.select("node", F.explode("bands").alias("key"))
    # counts are written down before they are joined, so that the join of a hot
    # bucket or group has two plain sides and is split at run time
    shared = stage(in_bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    members = in_bands.join(shared, "key").join(nodes.select("node", "n", F.col("sketch").alias("data")), "node")
    held: list[DataFrame] = []
    maybe = _links(members, shared, BUCKET_BLOCK, F.lit(1), _by_sketch(percent, slack), held)
    group = stage(connected_components(maybe))
    unstage(*held)
    held.clear()

    # whole sets of the grouped sequences, read again from one row of each
    grouped = stage(group.withColumnRenamed("component", "key").join(nodes.select("node", "doc_id", "n"), "node"))
    weight = F.col("n") + MEMBER_WEIGHT
    totals = stage(grouped.groupBy("key").agg(F.sum(weight).alias("members")))
    # no text is shuffled: the scan drops what is not wanted, by the ids if they
    # are few, else by a filter whose chance hits the join drops
    texts = source.select(F.xxhash64("doc_id").alias("h"), "text")
    wanted = grouped.select(F.xxhash64("doc_id").alias("h"))
    if _few(wanted):
        some, bits = texts.join(F.broadcast(wanted), "h", "left_semi"), None
    else:
        some, bits = texts, docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted))
    sets = some.mapInArrow(tidy(_sets(bits), _forget), "node binary, content binary").dropDuplicates(["node"])
    chosen = grouped.join(totals, "key").join(sets.withColumnRenamed("content", "data"), "node")
    chosen = chosen.select("key", "members", "node", "n", "data")
    links = _links(chosen, totals, GROUP_BLOCK, weight, _by_set(percent), held)
    joined = connected_components(links)

    found = stage(nodes.select("node", F.col("doc_id").alias("own")).join(joined, "node", "left"))
    least = stage(found.where("component IS NOT NULL").groupBy("component").agg(F.min("own").alias("least")))
    named = found.join(least, "component", "left").select("node", F.coalesce("least", "own").alias("component_id"))
    named = keep(stage(named))
    out = signed.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _hashed(shared, inside: bool):
    """The rows whose hash, their last column, is in the filter, or the others."""

    def work(batches):
        for batch in batches:
            known = _in_filter(batch.column(batch.num_columns - 1).to_numpy(), shared.value)
            some = batch.filter(pa.array(known == inside))
            yield some.select(range(batch.num_columns - 1))

    return work


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with the columns they came with.

    That of the smallest ``doc_id`` stays. Rows that share an id but not their
    text are different documents; of several with the smallest id of a group
    one stays, and of copies of a row, id and text alike, any one. A null id is
    larger than all others. Null, empty and wordless texts are linked with
    nothing and stay, one row for each id; very long texts are compared whole;
    an empty table stays empty.

    Few documents are shuffled. The keys of rows that are to go or that repeat
    are broadcast if they are few; else a filter of bounded size knows them,
    and the rows that it does not know pass the scan.
    """
    at, text = f"_{position(docs, 'doc_id')}", f"_{position(docs, 'text')}"
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    # bytes in the order of the ids, rows without one behind all others, then a digest of the text
    number = F.col(at).cast("long")
    ordered = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    digest = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))
    rows = plain.withColumn("key", F.unhex(F.concat(F.coalesce(F.concat(F.lit("00"), ordered), F.lit("01")), digest)))
    with scope() as keep:
        judged = near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col(text).alias("text")), percent, id_type="binary")
        # rows of one key are kept or dropped together
        by_key = judged.groupBy(F.col("doc_id").alias("key")).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
        doubtful = keep(stage(by_key.where("NOT kept OR n > 1").select("key", "kept")))
    if _few(doubtful):
        known = F.broadcast(doubtful)
        clear = rows.join(known, "key", "left_anti").select(plain.columns)
        if doubtful.where("kept").isEmpty():
            return clear.toDF(*docs.columns)
        unclear = rows.join(known.where("kept"), "key", "left_semi")
    else:
        bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(doubtful.select(F.xxhash64("key").alias("h"))))
        hashed = rows.withColumn("h", F.xxhash64("key"))
        clear = hashed.drop("key").mapInArrow(tidy(_hashed(bits, False)), plain.schema)
        unclear = hashed.mapInArrow(tidy(_hashed(bits, True)), rows.schema)
    # before the join, so that every task drops its copies before they are dealt by key
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(text)))
    one = unclear.withColumn("first", first).where("first = 1").join(doubtful.where("NOT kept"), "key", "left_anti")
    return clear.union(one.select(plain.columns)).toDF(*docs.columns)

"""Digests, checksums, hashes, paths and file types against other sources."""

import hashlib
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinfold.functions import checksums, digests, filetype, hashes, paths

TEXTS = ["", "a", "abc", "Grüße ☃ 𝄞", "x" * 1000, "\x00\x7f", "The quick brown fox jumps over the lazy dog"]
M = 0xFFFFFFFF


def values(spark, f, texts=TEXTS):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]
    assert got[-1] is None
    return got[:-1]


def test_md5(spark):
    assert values(spark, digests.md5_hex) == [hashlib.md5(t.encode()).hexdigest() for t in TEXTS]
    assert [bytes(x) for x in values(spark, digests.md5_raw)] == [hashlib.md5(t.encode()).digest() for t in TEXTS]
    row = spark.createDataFrame([("ab", None, "c")], "a string, b string, c string")
    assert row.select(digests.md5_parts(F.col("a"), F.col("b"), F.col("c"))).first()[0] == hashlib.md5(b"abc").hexdigest()


def test_hex(spark):
    assert values(spark, digests.bytes_to_hex) == [t.encode().hex().upper() for t in TEXTS]
    assert values(spark, lambda c: digests.bytes_to_hex(c, upper=False)) == [t.encode().hex() for t in TEXTS]


def test_adler32_and_crc(spark):
    assert values(spark, checksums.adler32) == [zlib.adler32(t.encode()) for t in TEXTS]
    assert values(spark, hashes.crc_hash) == [zlib.crc32(t.encode()) for t in TEXTS]


def weak(data):
    n = len(data)
    return sum(data) % 65536 + sum((n - i) * x for i, x in enumerate(data)) % 65536 * 65536


def test_weak_sum_and_rolling(spark):
    assert values(spark, checksums.adler32_rsync) == [weak(t.encode()) for t in TEXTS]
    data = bytes((i * 37 + 11) % 256 for i in range(200))
    rows = [(i, weak(data[i : i + 16]), data[i], data[i + 16]) for i in range(len(data) - 16)]
    df = spark.createDataFrame(rows, "i long, s long, a long, b long")
    rolled = df.select("i", checksums.adler32_rolling(F.col("s"), F.lit(16).cast("long"), F.col("a"), F.col("b")).alias("r"))
    assert all(r.r == weak(data[r.i + 1 : r.i + 17]) for r in rolled.collect())
    whole = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"short")), (3, None)], "k long, d binary")
    got = {(r.k, r["at"]): r.checksum for r in checksums.rolling_checksums(whole, "k", "d", 16).collect()}
    assert got == {(1, i): weak(data[i : i + 16]) for i in range(len(data) - 15)}


def test_windows_of_each_row(spark, monkeypatch):
    """Repeated keys, pieces, and columns that clash."""
    monkeypatch.setattr(checksums, "PIECE", 5)
    data = bytes((i * 91 + 7) % 256 for i in range(23))
    rows = [(1, bytearray(data), 0), (1, bytearray(data[:9]), 0), (1, bytearray(data), 0), (None, bytearray(b"abcd"), 0), (2, None, 0), (3, bytearray(), 0)]
    want = [(k, i, weak(bytes(d[i : i + 4]))) for k, d, _ in rows for i in range(len(d or b"") - 3)]
    for names in (["at", "d", "D"], ["k", "d", "checksum"], ["k", "d", "k"]):
        frame = spark.createDataFrame(rows, "a long, b binary, c int").toDF(*names)
        out = checksums.rolling_checksums(frame, names[0], "d", 4)
        assert out.columns == [names[0], "at", "checksum"]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert checksums.rolling_checksums(frame.where("d IS NULL"), "k", "d", 4).count() == 0
    with pytest.raises(ValueError):
        checksums.rolling_checksums(frame, "k", "d", 0)


def test_windows_of_many_values_share_batches(spark, monkeypatch):
    """The batches of the result follow its windows, not the values they are of."""
    frame = spark.createDataFrame([(i, chr(97 + i % 26) * (i % 13)) for i in range(3000)], "k long, d string").coalesce(1)
    made, plain_map = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda df, f, *args: made.append(f) or plain_map(df, f, *args))
    got = [tuple(r) for r in checksums.rolling_checksums(frame, "k", "d", 8).collect()]
    want = [(r.k, i, weak(r.d[i : i + 8].encode())) for r in frame.collect() for i in range(len(r.d) - 7)]
    assert got == want
    values = [b"abcdefgh" + b"i" * (i % 5) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(values, pa.binary())], names=["key", "data"])
    for rows in (batch, batch.slice(7, 2990)):
        assert [b.num_rows for b in made[0](iter([rows]))] == [sum(len(v) - 7 for v in rows.column(1).to_pylist())]


@pytest.mark.parametrize("length", [1, 3, 40])
def test_windows_of_mixed_lengths(spark, monkeypatch, length):
    """Long values are cut, short ones summed together, no window spans two."""
    monkeypatch.setattr(checksums, "PIECE", 32)
    data = [bytes((i * 61 + j * j * 7 + 5) % 256 for j in range([0, 1, 3, 2, 39, 200, 40, 5, 32, 33, 97][i % 11])) for i in range(60)]
    rows = [(str(i % 9), None if i % 10 == 7 else bytearray(d)) for i, d in enumerate(data)]
    frame = spark.createDataFrame(rows, "k string, d binary").coalesce(1)
    got = [tuple(r) for r in checksums.rolling_checksums(frame, "k", "d", length).collect()]
    assert got == [(k, i, weak(bytes(d[i : i + length]))) for k, d in rows for i in range(len(d or b"") - length + 1)]


def plain(name, data):
    h, n = {"djb": 5381, "djb2": 5381, "fnv": 2166136261, "js": 1315423911, "ap": 0xAAAAAAAA, "dek": len(data)}.get(name, 0), 63689
    for i, c in enumerate(data):
        if name == "ap":
            h ^= ((h << 7) ^ c * (h >> 3)) if i % 2 == 0 else ~((h << 11) + (c ^ (h >> 5)))
        elif name == "bkdr":
            h = h * 131 + c
        elif name == "bp":
            h = (h << 7) ^ c
        elif name == "djb":
            h = h * 33 + c
        elif name == "djb2":
            h = (h * 33) ^ c
        elif name == "dek":
            h = ((h << 5) ^ (h >> 27)) ^ c
        elif name in ("elf", "pjw"):
            h = ((h << 4) + c) & M
            h = (h ^ ((h & 0xF0000000) >> 24)) & 0x0FFFFFFF
        elif name == "fnv":
            h = (h * 16777619) ^ c
        elif name == "js":
            h ^= (h << 5) + c + (h >> 2)
        elif name == "rs":
            h, n = h * n + c, n * 378551 & M
        elif name == "sdbm":
            h = c + (h << 6) + (h << 16) - h
        h &= M
    return h


@pytest.mark.parametrize("name", [n for n in hashes.HASHES if n != "crc"])
def test_hashes(spark, name):
    got = values(spark, hashes.HASHES[name])
    assert got == [plain(name, t.encode()) for t in TEXTS]
    assert all(0 <= x <= M for x in got)


@pytest.mark.parametrize("name", [n for n in hashes.HASHES if n != "crc"])
def test_hashes_of_many_values(spark, name):
    """More values than lanes are worth, of many lengths, so that both ways are gone."""
    texts = ["é☃\x00"[i % 3] * (i % 7) + "x" * (i * i % 301) for i in range(120)] + ["y" * 5000, "z" * 4999]
    assert values(spark, hashes.HASHES[name], texts) == [plain(name, t.encode()) for t in texts]


def test_checksums_of_long_values(spark):
    texts = ["\xff" * 3_000_000, "ab" * 600_000]
    assert values(spark, checksums.adler32_rsync, texts) == [weak(t.encode()) for t in texts]
    assert values(spark, checksums.adler32, texts) == [zlib.adler32(t.encode()) for t in texts]


def test_bucket(spark):
    got = values(spark, lambda c: hashes.bucket(c, 997))
    assert got == [plain("rs", t.encode()) % 997 for t in TEXTS]


def test_uint2str(spark):
    df = spark.createDataFrame([(0,), (7,), (120,), (4294967295,)], "x long")
    got = df.select(paths.uint2str(F.col("x")), paths.uint2str_length(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("", 0), ("7", 1), ("120", 3), ("4294967295", 10)]


def test_file_ext(spark):
    names = ["a.txt", "a.tar.gz", "nodot", "x.", ".bashrc", "a/b.c/d", "A.TXT", ""]
    assert values(spark, paths.file_ext, names) == ["txt", "gz", None, "", "bashrc", "c/d", "TXT", None]


def test_target_path(spark):
    names = ["d/f.txt", "C:/d/f", "C:f", "/abs/f", "é:x"]
    got = values(spark, lambda c: paths.target_path(c, F.lit("out")), names)
    assert got == ["out/d/f.txt", "out//d/f", "out/f", "out//abs/f", "out/é:x"]
    assert values(spark, lambda c: F.to_json(paths.target_directories(c)), ["out/a/f", "f", "/r/f"]) == [
        '["out","out/a"]',
        "[]",
        '["/r"]',
    ]


def test_lists(spark):
    df = spark.createDataFrame([("a",), ("A",), (None,)], "path string")
    assert [r[0] for r in df.select(paths.in_list(F.col("path"), ["a", "b"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(paths.in_list(F.col("path"), [])).collect()] == [False, False, False]
    assert [r.path for r in paths.semi_list(df, "path", df.where("path = 'a'")).collect()] == ["a"]


def test_compare_keys(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("Z", "a"), ("é", "z"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(paths.compare_keys(F.col("a"), F.col("b"))).collect()]
    assert got == [-1, 1, 0, -1, 1, None]


def test_file_type(spark):
    data = [b"\x89PNG\r\n\x1a\n...", b"%PDF-1.7", b"PK\x03\x04", b"<!DOCTYPE html>", b"BZh9", b"hello", b""]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary").orderBy("i")
    assert [r[0] for r in df.select(filetype.file_type(F.col("d"))).collect()] == ["png", "pdf", "zip", "html", "bz2", None, None]
    assert spark.range(1).select(filetype.magic_map()[F.lit("1F8B")]).first()[0] == "gz"

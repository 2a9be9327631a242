"""Persistent tables, paged arrays, files, and duplicate elimination."""

import hashlib

import pytest
from pyspark.sql import functions as F

from twinfold.functions.hashes import crc_hash
from twinfold.operators import dedup
from twinfold.operators.bigtable import BigTable
from twinfold.operators.listdb import VALUE_GET, VALUE_SET, ListDB
from twinfold.sources import files, staging

PAIRS = "Beauty Food=1st_newfill,suit=2nd,Heal=3rd,Orange=4th,range=5th,red=6th,suit=12f,suit=13so,empty="


def test_big_table(spark, tmp_path):
    rows = [(i, *p.split("=")) for i, p in enumerate(PAIRS.split(","))]
    path = f"{tmp_path}/big"
    probes = spark.createDataFrame([("suit",), ("beauty Food",), ("Beauty Food",), ("empty",)], "key string")
    with BigTable(spark, path, keep=True) as t:
        assert t.is_new
        t.insert(spark.createDataFrame(rows, "seq long, key string, value string"))
        got = {r.key: (r.value and bytes(r.value), r.value_size) for r in t.get(probes).collect()}
        assert got["suit"] == (b"13so", 4) and got["beauty Food"] == (None, 0) and got["empty"][1] == 0
        contained = {r.key: r.contained for r in t.contains(probes).collect()}
        assert contained == {"suit": True, "beauty Food": False, "Beauty Food": True, "empty": True}
        assert sorted(r.key for r in t.containing(probes).collect()) == ["Beauty Food", "empty", "suit"]
    with BigTable(spark, path) as t:
        assert not t.is_new
        t.insert(spark.createDataFrame([("suit", "again")], "key string, value string"))
        assert bytes(t.get(probes.where("key = 'suit'")).first()["value"]) == b"again"
    assert not files.path_exists(spark, path)


def test_big_table_probes_and_filter(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", f"v{i}", i) for i in range(300)], "key string, value string, value_size int")
    probes = spark.createDataFrame([(f"k{i}", 1, 2) for i in range(0, 600, 2)] + [(None, 1, 2), ("k2", 1, 2)], "k string, x int, y int")
    with BigTable(spark, f"{tmp_path}/t") as t:
        t.insert(rows)
        t.write_filter(1 << 14)
        for names in (["key", "value", "VALUE_SIZE"], ["key", "value", "value"], ["key", "KEY", "contained"]):
            given = probes.toDF(*names)
            got = t.get(given)
            assert got.columns[-2:] == ["value", "value_size"] and got.count() == 302
            assert sorted({bytes(r[-2]).decode() for r in got.collect() if r[-2]}) == sorted(f"v{i}" for i in range(0, 300, 2))
            assert sum(r[-1] for r in t.contains(given).collect()) == 151
            assert t.containing(given).columns == names and t.containing(given).count() == 151
            maybe = {r[0]: r[-1] for r in t.may_contain(given).collect()}
            assert all(maybe[f"k{i}"] for i in range(0, 300, 2)) and maybe[None] is None
            assert sum(maybe[f"k{i}"] for i in range(300, 600, 2)) < 15
        assert not t.may_contain(probes.withColumnRenamed("k", "key").where("false")).count()
    assert not files.path_exists(spark, f"{tmp_path}/t") and not files.path_exists(spark, f"{tmp_path}/t_filter")


def test_get_reads_the_values_of_last_writes_only(spark, tmp_path):
    """The values are joined to what was found without them, in a semi join."""
    with BigTable(spark, f"{tmp_path}/t") as t:
        for i in range(3):
            t.insert(spark.createDataFrame([("a", f"v{i}"), ("b", f"w{i}")], "key string, value string"))
        got = t.get(spark.createDataFrame([("a",)], "key string"))
        assert bytes(got.first()["value"]) == b"v2"
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan
        scans = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in line]
        assert sum("value#" in s for s in scans) == 1


def test_staging(spark, tmp_path):
    with staging.scope() as keep:
        a, b = staging.stage(spark.range(3)), keep(staging.stage(spark.range(5)))
        assert a.count() == 3 and files.path_exists(spark, a._twinfold_path)
    assert not files.path_exists(spark, a._twinfold_path) and b.count() == 5
    staging.unstage(b)
    assert not files.path_exists(spark, b._twinfold_path)


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def test_big_table_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):  # noqa: B017
        BigTable(spark, f"{tmp_path}/broken", keep=True)


def test_big_table_null_key(spark, tmp_path):
    with BigTable(spark, f"{tmp_path}/null") as t, pytest.raises(Exception, match="null key"):
        t.insert(spark.createDataFrame([(None, "v")], "key string, value string"))


def test_list_db(spark, tmp_path):
    path = f"{tmp_path}/list"
    writes = spark.createDataFrame([(1, 5, "aaaa"), (2, 5, "bbbb"), (3, 9, "cccc")], "seq long, idx long, value string")
    probes = spark.createDataFrame([(5,), (9,), (7,)], "idx long")
    array = ListDB.open(spark, path, 4).apply(VALUE_SET, writes)
    array.save(path)
    array = ListDB.open(spark, path, 4).cached()
    got = {r.idx: r.value and bytes(r.value) for r in array.apply(VALUE_GET, probes).collect()}
    assert got == {5: b"bbbb", 9: b"cccc", 7: None}
    again = array.setvalue(spark.createDataFrame([(0, 9, "dddd")], "seq long, idx long, value string"))
    assert bytes(again.getvalue(probes.where("idx = 9")).first()["value"]) == b"dddd"
    with pytest.raises(Exception, match="another width"):
        array.setvalue(spark.createDataFrame([(0, 9, "toolong")], "seq long, idx long, value string")).rows.collect()
    with pytest.raises(ValueError):
        array.apply(7, probes)
    with pytest.raises(ValueError):
        ListDB.empty(spark, 0)
    clashing = spark.createDataFrame([(5, 1, 2), (7, 3, 4)], "i long, x int, y int").toDF("idx", "value", "Value")
    out = ListDB.open(spark, path, 4).getvalue(clashing)
    assert out.columns == ["idx", "value"] and {r.idx: r.value and bytes(r.value) for r in out.collect()} == {5: b"bbbb", 7: None}
    assert ListDB.unlink(spark, path) and not ListDB.unlink(spark, path)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.PNG").write_bytes(b"\x89PNG\r\n\x1a\n")
    found = files.read_files(spark, str(tmp_path))
    sums = {r.path.rpartition("/")[2]: (r.length, r.md5) for r in files.file_digests(found).collect()}
    assert sums["a.txt"] == (5, hashlib.md5(b"hello").hexdigest())
    kinds = {r.path.rpartition("/")[2]: (r.ext, r.type) for r in files.file_types(found).collect()}
    assert kinds == {"a.txt": ("txt", None), "b.PNG": ("PNG", "png")}
    assert files.read_files(spark, str(tmp_path), pattern="*.txt").count() == 1


def test_dedup(spark):
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None), (6, "")], "id long, t string")
    groups = {r.canonical: r.refs for r in dedup.fingerprints(docs, "id", "t").collect()}
    assert groups == {1: 2, 2: 1, 4: 2, 6: 1}
    assert {r.key: r.canonical for r in dedup.canonical_map(docs, "id", "t").collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6}
    match = dedup.two_level_match(docs.where("t IS NOT NULL"), "id", "t", crc_hash(F.col("t")))
    assert [tuple(r) for r in match.collect()] == [(3, 1)]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "ab" * 700), (2, "ab" * 256), (3, ""), (4, None)], "id long, t string")
    chunks = dedup.fixed_chunks(docs, "id", "t")
    got = {(r.key, r.chunk): bytes(r.content) for r in chunks.collect()}
    assert b"".join(got[1, i] for i in range(3)) == b"ab" * 700 and len(got) == 4 and len(got[1, 2]) == 376
    total = dedup.chunk_savings(chunks).first()
    assert (total.chunks, total.bytes, total.unique_chunks, total.unique_bytes) == (4, 1912, 2, 888)
    with pytest.raises(ValueError):
        dedup.fixed_chunks(docs, "id", "t", 0)

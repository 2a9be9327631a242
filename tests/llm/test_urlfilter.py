"""URL filters: the query against SQL, and cases against a walk over the list."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from twinfold.llm import urlfilter
from twinfold.llm.queries import ORACLE_SQL, op5_url_filters

DAY = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(n)


def test_query(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    want = con.execute(ORACLE_SQL["op5_url_filters"]).fetchall()
    got = [tuple(r) for r in op5_url_filters(spark, small).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


ENTRIES = [
    ("l", "block", "Example.com", 0, "add"),
    ("l", "block", "example.com", 10, "remove"),
    ("l", "block", "example.com", 20, "add"),
    ("l", "block", "example.com", 20, "add"),
    ("m", "block", "bad.org/a/b/", 5, "add"),
    ("n", "allow", "bad.org/a/b", 8, "add"),
    ("l", "block", "same.net", 3, "add"),
    ("l", "block", "same.net", 3, "remove"),
    ("l", "block", "[2001:DB8::1]", 0, "add"),
    (None, "block", "null.net", 0, "add"),
    ("l", "block", None, 0, "add"),
]


@pytest.mark.parametrize(
    "url, fetched, blocked, by",
    [
        ("http://example.com/x", 0, True, "example.com"),
        ("https://WWW.Example.com:8080/x?y#z", 9, True, "example.com"),
        ("http://example.com/", 10, False, None),
        ("http://a.b.example.com", 400, True, "example.com"),
        ("http://notexample.com/", 1, False, None),
        ("http://example.com.evil.net/", 1, False, None),
        ("http://bad.org/a/b/c.html", 6, True, "bad.org/a/b"),
        ("http://bad.org/a/b/c.html", 8, False, "bad.org/a/b"),
        ("http://bad.org/a/bc", 6, False, None),
        ("http://user:pw@bad.org/a//b", 6, True, "bad.org/a/b"),
        ("http://same.net/", 5, False, None),
        ("http://null.net/", 5, False, None),
        ("no url at all", 5, False, None),
        # slashes that lean the other way, no scheme, addresses
        ("http:\\\\example.com\\x", 0, True, "example.com"),
        ("example.com/x", 0, True, "example.com"),
        ("//example.com:81?q=a b", 0, True, "example.com"),
        ("bad.org\\a\\b?c", 6, True, "bad.org/a/b"),
        ("http://[2001:db8::1]:80/x", 5, True, "[2001:db8::1]"),
        ("http://[2001:db8::2]/x", 5, False, None),
        ("mailto:me@example.com", 5, False, None),
        (None, 5, False, None),
        ("http://example.com/", None, False, None),
        ("http://example.com/", -1, False, None),
    ],
)
def test_cases(spark, url, fetched, blocked, by):
    entries = [(a, k, p, day(d), x) for a, k, p, d, x in ENTRIES]
    lists = spark.createDataFrame(entries, "list string, kind string, pattern string, listed_on date, action string")
    rows = spark.createDataFrame([(url, day(fetched), "keep", 1)] * 2, "url string, fetched_on date, extra string, blocked int")
    got = urlfilter.filter_urls(rows, lists).collect()
    assert [(r.blocked, r.decided_by, r.extra) for r in got] == [(blocked, by, "keep")] * 2


def test_random_lists(spark):
    rng = random.Random(3)
    hosts = ["a.com", "x.a.com", "b.com", "com"]
    entries = [
        (rng.choice("lm"), rng.choice(["block", "allow"]), rng.choice(hosts) + rng.choice(["", "/p", "/p/q"]), rng.randrange(30), rng.choice(["add", "add", "remove"]))
        for _ in range(80)
    ]
    captures = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'p', 'p/q', 'p/q/r', 'z'])}", rng.randrange(35)) for i in range(200)]

    def judged(url, d):
        name, _, path = url.removeprefix("http://").partition("/")
        best, n = None, 0
        for one in {e[:3] for e in entries}:
            host, _, prefix = one[2].partition("/")
            inside = name == host and f"{path}/".startswith(f"{prefix}/") if prefix else f".{name}".endswith(f".{host}")
            past = [e for e in entries if e[:3] == one and e[3] <= d]
            last = [e[4] for e in past if e[3] == max(p[3] for p in past)]
            if inside and past and "remove" not in last:
                n += 1
                best = min(best or (9,), (-len(one[2]), one[1], one[0]))
        return n, best is not None and best[1] == "block"

    lists = spark.createDataFrame([(*e[:3], day(e[3]), e[4]) for e in entries], "list string, kind string, pattern string, listed_on date, action string")
    rows = spark.createDataFrame([(i, u, day(d)) for i, u, d in captures], "id long, url string, fetched_on date")
    got = {r.id: (r.n_active, r.blocked) for r in urlfilter.filter_urls(rows, lists).collect()}
    assert got == {i: judged(u, d) for i, u, d in captures}


def test_empty_tables(spark):
    lists = spark.createDataFrame([], "list string, kind string, pattern string, listed_on date, action string")
    rows = spark.range(3).select(F.lit("http://a.com/").alias("url"), F.current_date().alias("fetched_on"))
    assert urlfilter.filter_urls(rows, lists).where("blocked").count() == 0
    assert urlfilter.filter_urls(rows.where("false"), lists).count() == 0


def test_a_hot_pattern_is_joined_once(spark):
    """A pattern with a long history is one row for each capture, not one for each interval."""
    entries = [("l", "block", "hot.org", dt.date(2020, 1, 1) + dt.timedelta(i), "add" if i % 2 == 0 else "remove") for i in range(400)]
    lists = spark.createDataFrame(entries, "list string, kind string, pattern string, listed_on date, action string")
    captures = spark.createDataFrame([(i, "http://hot.org/a", dt.date(2020, 1, 1) + dt.timedelta(i % 420)) for i in range(500)], "i int, url string, fetched_on date")
    rows = urlfilter.filter_urls(captures, lists).collect()
    assert all(r.blocked == (r.i % 420 % 2 == 0 and r.i % 420 < 400) for r in rows) and len(rows) == 500

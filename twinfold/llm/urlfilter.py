"""URL filters with dated lists: validity intervals and an as-of join.

A list is a history of entries: on a date a pattern is added to a list or
removed from it. Consecutive entries of a pattern become validity intervals,
and every capture is judged by the entries active on the day it was fetched,
not by the list as it stands now. All of it is DataFrame expressions.

Patterns are host names, which cover their subdomains (``example.com``), or a
host with whole path segments (``example.com/a/b``), which covers what lies
below. Of the active patterns that cover a URL the longest decides; an
``allow`` entry wins a tie with a ``block`` entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.frames import pick, position, stage

#: Host and path of a URL. Scheme, user and port are dropped, slashes may lean
#: either way as browsers take them, a host may stand alone or be an address in
#: brackets, and the path ends before a query or fragment.
URL = (
    r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\][/\\](?:[^/\\?#@]*@)?)?"
    r"(\[[0-9A-Fa-f:.%]+\]|[^/\\?#:@\s\[\]]+)(?::[0-9]*)?([/\\][^?#]*)?(?:[?#][\s\S]*)?$"
)
#: Rows of the table that drops patterns which no list has, at most.
FILTER_ROWS = 1 << 20


def host(url: Column) -> Column:
    """The lower-case host without a final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.$", "")


def path_segments(url: Column) -> Column:
    """The segments of the path that are not empty."""
    return F.filter(F.split(F.regexp_extract(url, URL, 2), r"[/\\]"), lambda s: s != "")


def normal_pattern(pattern: Column) -> Column:
    """A pattern with its host in lower case and without empty segments."""
    parts = F.filter(F.split(pattern, "/"), lambda s: s != "")
    name = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"^\.+|\.+$", "")
    return F.array_join(F.concat(F.array(name), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def patterns_of(url: Column, most_segments: int) -> Column:
    """All patterns that can cover a URL: suffixes of its host, and its host
    with the first segments of its path. No host, no pattern.

    ``most_segments`` is what the longest pattern of the lists has, so longer
    prefixes could match nothing.
    """
    name, segments = host(url), path_segments(url)
    labels = F.when(F.startswith(name, F.lit("[")), F.array(name)).otherwise(F.split(name, r"\."))
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )
    some = F.slice(segments, 1, most_segments) if most_segments else F.array().cast("array<string>")
    paths = F.transform(some, lambda _, i: F.concat(name, F.lit("/"), F.array_join(F.slice(some, 1, i + 1), "/")))
    nothing = F.array().cast("array<string>")
    return F.when(F.coalesce(name, F.lit("")) == "", nothing).otherwise(F.concat(domains, paths))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Rows ``(list, kind, pattern, valid_from, valid_to)`` from dated entries.

    ``entries`` has ``list, kind, pattern, listed_on, action``: kind ``block``
    or ``allow``, action ``add`` or ``remove``. An addition holds from its day
    until the day of the pattern's next entry in that list; the last one has a
    null end. Of several entries on one day a removal wins. Entries with a
    null field are left out; repeated entries change nothing.

    Entries are first reduced to one for each day, so the window of a pattern
    never holds more rows than there are days in its history.
    """
    keys = ["list", "kind", "pattern"]
    rows = pick(entries, *keys, "listed_on", "action").dropna().withColumn("pattern", normal_pattern(F.col("pattern")))
    days = rows.where("pattern != ''").groupBy(*keys, "listed_on").agg(
        F.max(F.col("action") == "remove").alias("removed")
    )
    following = F.lead("listed_on").over(Window.partitionBy(*keys).orderBy("listed_on"))
    return (
        days.withColumn("valid_to", following)
        .where(~F.col("removed"))
        .select(*keys, F.col("listed_on").alias("valid_from"), "valid_to")
    )


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Judge every capture by the list entries active when it was fetched.

    ``captures`` has ``url`` and ``fetched_on``; all its columns pass through
    but those named like an added one. Added are ``n_active``, the number of
    active entries that cover the URL, ``decided_by`` (their longest pattern;
    null if none), ``decided_list`` and ``blocked``. A null URL, one without a
    host, and a null day are covered by nothing. Repeated captures are judged
    alike, empty lists block nothing, and no captures give no rows.

    A hot host is no hot task: the as-of join finds one row for each pattern,
    which holds its intervals in order, and its large partitions are split at
    run time; everything after it is keyed by the capture. A pattern has no
    more intervals than its history has days.
    """
    added = ["n_active", "decided_by", "decided_list", "blocked"]
    source = captures.toDF(*[f"_{i}" for i in range(len(captures.columns))])
    names = [c.lower() for c in captures.columns]
    kept = [i for i, c in enumerate(names) if c not in added]
    at = {c: position(captures, c) for c in ("url", "fetched_on")}
    source = stage(source.select(*[f"_{i}" for i in kept], F.monotonically_increasing_id().alias("tag")))
    lists = stage(validity_intervals(entries))
    # one number, however long the lists are
    deepest = lists.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    asked = source.select(
        "tag",
        F.col(f"_{at['fetched_on']}").cast("date").alias("day"),
        F.explode(patterns_of(F.col(f"_{at['url']}"), deepest)).alias("pattern"),
    ).where("day IS NOT NULL")
    # patterns that no list has go before anything is shuffled; a hash of
    # bounded range, so that the table of those to keep can be broadcast
    slot = F.pmod(F.xxhash64("pattern"), F.lit(FILTER_ROWS)).cast("int").alias("slot")
    asked = asked.withColumn("slot", slot).join(F.broadcast(lists.select(slot).distinct()), "slot", "left_semi")
    # one row for each pattern, with its intervals as of their beginning
    spans = lists.groupBy("pattern").agg(
        F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "kind", "list"))).alias("spans")
    )
    day = F.col("day")
    begun = F.filter("spans", lambda x: (x["valid_from"] <= day) & (x["valid_to"].isNull() | (day < x["valid_to"])))
    active = asked.join(spans, "pattern").select("tag", "pattern", begun.alias("active")).where(F.size("active") > 0)
    # 'allow' sorts before 'block', and then the smaller list name counts
    first = F.array_min(F.transform("active", lambda x: F.struct(x["kind"].alias("kind"), x["list"].alias("list"))))
    by = F.struct((-F.length("pattern")).alias("short"), first.alias("first"), "pattern")
    hits = active.select("tag", F.size("active").alias("n"), by.alias("by"))
    hits = hits.groupBy("tag").agg(F.sum("n").alias("n"), F.min("by").alias("by"))
    hits = hits.select("tag", "n", F.struct("by.pattern", "by.first.list", "by.first.kind").alias("by"))
    out = source.join(hits, "tag", "left")
    return out.select(
        *[F.col(f"_{i}").alias(captures.columns[i]) for i in kept],
        F.coalesce("n", F.lit(0).cast("long")).alias("n_active"),
        F.col("by.pattern").alias("decided_by"),
        F.col("by.list").alias("decided_list"),
        F.coalesce(F.col("by.kind") == "block", F.lit(False)).alias("blocked"),
    )

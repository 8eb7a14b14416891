"""URL filters by a temporal list join.

Dated entries (added to or removed from a list) become validity intervals. Every capture's host and path give the
keys under which an entry could name it, and an as-of join keeps the entries that were active when it was
fetched. A key has one row that holds all its intervals, so the join never makes more rows than it was given. All of it is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import written

#: Bytes of a list that is sent to all tasks; a key is heavy from this fraction of what is asked.
SENT_BYTES, HEAVY = 16 << 20, 1_000


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; null if the URL has none."""
    rest = F.regexp_replace(F.lower(F.trim(url)), F.lit(r"^[a-z][a-z0-9+.\-]*://"), F.lit(""))
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.nullif(F.regexp_replace(F.regexp_replace(authority, F.lit("^.*@"), F.lit("")), F.lit(r"\.?(:\d*)?$"), F.lit("")), F.lit(""))


def path_of(url: Column) -> Column:
    """The segments of the path, as written, without query and fragment; empty segments are left out."""
    rest = F.regexp_replace(F.trim(url), F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.lit(""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit("^[^/]*"), F.lit(""))
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (list_name, polarity, kind, entry, action, at) -> (key, valid: array of list_name, polarity, start, stop).

    kind ``domain`` names a host and all below it, kind ``url`` a host and path and all below. action is ``add`` or ``remove``; an
    entry is active from an add up to the next remove, which is the first moment it isn't. At one time add wins over remove.
    Repeated adds change nothing. Entries with a null in list_name, kind, entry, action or at, or with another kind or action, say nothing. A polarity other than ``allow`` counts as ``block``.
    """
    host, path = host_of(F.col("entry")), path_of(F.col("entry"))
    key = F.when(F.col("kind") == "domain", F.concat(F.lit("d:"), host)).when(F.col("kind") == "url", F.concat(F.lit("u:"), F.concat_ws("/", host, F.array_join(path, "/"))))
    named = entries.select("list_name", F.when(F.col("polarity") == "allow", "allow").otherwise("block").alias("polarity"), key.alias("key"), "at", F.when(F.col("action") == "add", 1).when(F.col("action") == "remove", 0).alias("on"))
    named = named.where("list_name is not null and key is not null and at is not null and on is not null and length(key) > 2")
    one = named.groupBy("list_name", "polarity", "key", "at").agg(F.max("on").alias("on"))
    along = Window.partitionBy("list_name", "polarity", "key").orderBy("at")
    changes = one.withColumn("was", F.coalesce(F.lag("on").over(along), F.lit(0))).where("on <> was")
    spans = changes.withColumn("stop", F.lead("at").over(along)).where("on = 1")
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("list_name", "polarity", F.col("at").alias("start"), "stop"))).alias("valid"))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """One row for each row of ``captures``: id, url, time, host, matches, blocked.

    matches are the active entries as texts ``list polarity key``, sorted. A capture is blocked if it matches a block entry and no allow entry; list names may hold anything, blanks and the names of the polarities too. A capture
    without host or time matches nothing and takes no part in the join. Captures that agree in id, url and time are looked up once and all stay. Null ids and other columns matter to nothing. An empty list matches
    nothing; an empty table gives an empty result. Very long URLs are asked for no more keys than the longest entry has parts.

    A list of more than ``sent_bytes`` meets the captures in a shuffle by key. Keys that many captures ask for, such as those of top-level domains, are counted first: at most HEAVY of them can be heavy, so what the list
    says of them is sent to all tasks, and no task gets the captures of a heavy key.
    """
    # Written, so that its size is known.
    valid = written(intervals(entries), "list-intervals")
    # No key has more labels or segments than the longest entry: longer ones need not be asked for.
    depth = F.size(F.split(F.substring("key", 3, 1 << 30), r"[./]"))
    size = F.length("key") + F.aggregate("valid", F.lit(0), lambda n, v: n + F.length(v["list_name"]) + 40)
    most = valid.agg(F.max(F.when(F.startswith("key", F.lit("d:")), depth)), F.max(F.when(F.startswith("key", F.lit("u:")), F.size(F.split("key", "/")))), F.sum(size)).first()
    labels, segments, list_bytes = most[0] or 0, most[1] or 0, most[2] or 0

    rows = captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{at_col}`").alias("at"))
    rows = rows.groupBy("id", "url", "at").agg(F.count("*").alias("n")).withColumn("host", host_of(F.col("url")))
    capture = ["id", "url", "at", "n", "host"]
    names, path = F.split("host", r"\."), path_of(F.col("url"))
    none = F.array().cast("array<string>")
    below = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(names, -n, n), "."))) if labels else none
    above = F.transform(F.sequence(F.lit(0), F.least(F.size(path), F.lit(segments - 1))), lambda n: F.concat(F.lit("u:"), F.concat_ws("/", F.col("host"), F.nullif(F.array_join(F.slice(path, 1, n), "/"), F.lit(""))))) if segments else none
    asked = rows.where("host is not null and at is not null").withColumn("key", F.explode(F.concat(below, above)))
    if list_bytes <= sent_bytes:
        met = asked.join(F.broadcast(valid), "key")
    else:
        counts = written(asked.groupBy("key").agg(F.count("*").alias("asked")), "asked-keys")
        heavy = counts.where(F.col("asked") * HEAVY > (counts.agg(F.sum("asked")).first()[0] or 0))
        heavy = written(heavy.select("key").join(valid, "key", "left"), "heavy-keys")
        met = asked.join(F.broadcast(heavy.where("valid is not null")), "key")
        met = met.unionByName(asked.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(valid, "key"))
    active = F.filter("valid", lambda v: (v["start"] <= F.col("at")) & (v["stop"].isNull() | (F.col("at") < v["stop"])))
    said = F.transform(active, lambda v: F.struct(F.concat_ws(" ", v["list_name"], v["polarity"], F.col("key")).alias("said"), v["polarity"].alias("polarity")))
    hits = met.withColumn("m", said).where("size(m) > 0").select(*capture, "m")
    every = hits.unionByName(rows.where("host is not null and at is not null").withColumn("m", F.lit(None).cast(hits.schema["m"].dataType)))
    found = every.groupBy(*capture).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("m"))
    found = found.unionByName(rows.where("host is null or at is null").withColumn("m", F.array().cast(hits.schema["m"].dataType)))
    has = lambda p: F.exists("m", lambda m: m["polarity"] == p)
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(at_col), "host", F.transform("m", lambda m: m["said"]).alias("matches"), (has("block") & ~has("allow")).alias("blocked"))

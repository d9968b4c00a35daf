"""URL filters by a temporal list join (native expressions only).

A list is a history: dated entries add or remove a pattern. Per pattern the entries become validity intervals, from an
addition (inclusive) to the next removal (exclusive, or open). A capture is judged by the intervals active at its fetch time.

Patterns are keys of an equi-join: a host pattern matches a host and all its subdomains, a prefix pattern matches a host and
the beginning of the path in whole segments, as deep as the list's deepest prefix. Patterns and captures have one normal
form: the host in lower case, the path as it is, slashes in a row as one. A capture is looked up under each suffix of its
host and each prefix of its path. The intervals of a key stand in one row, so a capture meets a key at most once, whatever the history, and
the as-of condition is evaluated inside the row. Lookups are salted, so a host with a third of all captures is dealt out.

Defined cases: a null or unparsable url has no host and is never listed; a null fetch time is never listed; entries at the same
instant for one pattern: a removal comes after an addition; repeated additions or removals change nothing; repeated rows stay;
an empty table of pages gives no rows, an empty list lists none; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomlens.llm.common import with_row_id

SALTS = 16
INTERVAL = "array<struct<valid_from:timestamp,valid_to:timestamp>>"


def host(url: Column) -> Column:
    """The host in lower case without user, port, and a dot at the end; '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), r"\.+$", "")


def path(url: Column) -> Column:
    """The path without query and fragment, '' where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def lookup_keys(host_: Column, path_: Column, deepest: int) -> Column:
    """All keys under which a capture may be listed: 'host:<suffix>' and 'prefix:<host>/<segments>' of up to deepest segments."""
    labels = F.split(host_, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    parts = F.filter(F.split(path_, "/"), lambda p: p != "")
    depth = F.least(F.size(parts), F.lit(deepest))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.concat(F.array(F.concat(F.lit("prefix:"), host_)), F.slice(parts, F.lit(1), k)), "/"))
    return F.when(host_ != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """(key, intervals) from dated entries (pattern, kind, action, at); kind is host or prefix, action add or remove."""
    known = entries.filter(F.col("kind").isin("host", "prefix") & F.col("action").isin("add", "remove") & F.col("at").isNotNull() & F.col("pattern").isNotNull())
    host_ = F.substring_index("pattern", "/", 1)
    path_ = F.regexp_replace(F.regexp_replace(F.substring("pattern", F.char_length(host_) + 1, F.char_length("pattern")), "/+", "/"), "/$", "")
    keyed = known.select(F.concat("kind", F.lit(":"), F.lower(host_), path_).alias("key"), (F.col("action") == "add").alias("on"), F.col("at").cast("timestamp").alias("at")).distinct()
    by_time = Window.partitionBy("key").orderBy(F.col("at"), F.col("on").desc())
    changes = keyed.withColumn("before", F.lag("on").over(by_time)).filter(F.col("on") != F.coalesce("before", F.lit(False)))
    spans = changes.withColumn("until", F.lead("at").over(by_time)).filter(F.col("on") & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("valid_from"), F.col("until").alias("valid_to")))).alias("intervals"))


def deepest_prefix(lists: DataFrame) -> int:
    """The number of path segments of the deepest prefix pattern, 0 without any."""
    depth = F.size(F.split("key", "/")) - 1
    return lists.filter(F.startswith("key", F.lit("prefix:"))).agg(F.max(depth)).first()[0] or 0


def listed(pages: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", id_col: str = "page_id") -> DataFrame:
    """(id, host, fetched, listed, rule, valid_from, valid_to, active_rules): the first active rule by key, and how many are."""
    rows = with_row_id(pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.col(time_col).cast("timestamp").alias("fetched")))
    intervals = validity(entries)
    keyed = rows.withColumn("key", F.explode_outer(lookup_keys(F.col("host"), F.col("path"), deepest_prefix(intervals)))).withColumn("salt", F.pmod(F.xxhash64("_rid"), F.lit(SALTS)).cast("int"))
    lists = intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = keyed.join(lists, ["key", "salt"], "left")
    active = F.get(F.filter("intervals", lambda s: (s["valid_from"] <= F.col("fetched")) & (s["valid_to"].isNull() | (s["valid_to"] > F.col("fetched")))), F.lit(0))
    rule = F.when(active.isNotNull(), F.struct(F.col("key").alias("rule"), active.alias("span")))
    judged = joined.withColumn("found", rule).groupBy("_rid").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("fetched").alias("fetched"), F.min("found").alias("best"), F.count("found").alias("active_rules"))
    return judged.select(
        "id", "host", "fetched", (F.col("active_rules") > 0).alias("listed"), F.col("best.rule").alias("rule"), F.col("best.span.valid_from").alias("valid_from"), F.col("best.span.valid_to").alias("valid_to"), "active_rules"
    )


def _number(text: Column) -> Column:
    """A number from the first 28 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int")


def history(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A made list over the hosts and paths of pages, for tables without one: (pattern, kind, action, at).

    A host is added or removed in each month of 2024 as a hash of host and month says. One path in three is added as a
    prefix, with the host in upper case, and half of these are removed 60 days later; another one in three stands in the list
    in upper case and with five more segments, neither of which the page itself matches.
    """
    seen = pages.select(host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path")).filter(F.col("host") != "").distinct()
    months = seen.select("host").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("code", _number(F.concat_ws("#", "host", F.col("month").cast("string"))))
    hosts = months.filter(F.col("code") % 4 < 2).select(F.col("host").alias("pattern"), F.lit("host").alias("kind"), F.when(F.col("code") % 4 == 0, "add").otherwise("remove").alias("action"), F.make_date(F.lit(2024), "month", 1 + F.col("code") % 28).cast("timestamp").alias("at"))
    coded = seen.withColumn("code", _number(F.concat("host", "path"))).withColumn("on", F.make_date(F.lit(2024), 1 + F.col("code") % 12, 1 + F.col("code") % 28))
    known, other = coded.filter(F.col("code") % 3 == 0), coded.filter(F.col("code") % 3 == 1)
    entries = [
        known.select(F.concat(F.upper("host"), "path").alias("pattern"), F.lit("add").alias("action"), "on"),
        known.filter(F.col("code") % 2 == 0).select(F.concat("host", "path").alias("pattern"), F.lit("remove").alias("action"), F.date_add("on", 60).alias("on")),
        other.select(F.concat("host", F.upper("path")).alias("pattern"), F.lit("add").alias("action"), "on"),
        other.select(F.concat("host", "path", F.lit("/a/b/c/d/e")).alias("pattern"), F.lit("add").alias("action"), "on"),
    ]
    prefixes = reduce(DataFrame.unionByName, entries).select("pattern", F.lit("prefix").alias("kind"), "action", F.col("on").cast("timestamp").alias("at"))
    return hosts.unionByName(prefixes)


def with_fetch_time(pages: DataFrame) -> DataFrame:
    """Synthetic captures carry no time: the page id spreads them over the 366 days of 2024."""
    return pages.withColumn("fetched", F.timestamp_add("DAY", F.pmod(F.col("page_id"), F.lit(366)).cast("int"), F.lit("2024-01-01").cast("timestamp")))

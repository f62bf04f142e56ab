"""URL filters whose lists change over time: every capture meets the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridprobe.llm.common import stage

# What a URL entry counts for against host entries, which count their labels.
EXACT = 1_000


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and final dot; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def address_of(url: Column) -> Column:
    """Host, path and query, without scheme, fragment and final slashes; empty if there is no host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) == "", "").otherwise(F.concat(host_of(url), F.regexp_replace(rest, r"/+$", "")))


def _suffixes(host: Column) -> Column:
    """A host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list, scope, pattern, action, since, until) from dated entries; until is exclusive, NULL while open.

    An ``add`` holds from its day until the next ``remove`` of the same entry. Of several events on one day a
    removal wins; an entry that is added again while it holds goes on. Events count once per day, so an entry has no more of
    them than there are days. Entries with a NULL in any column are ignored.
    """
    key = ["list", "scope", "pattern", "action"]
    daily = entries.dropna().groupBy(*key, "day").agg(F.max((F.col("event") == "remove").cast("int")).alias("removed"))
    order = Window.partitionBy(*key).orderBy("day")
    changes = daily.withColumn("before", F.lag("removed", 1, 1).over(order)).filter("removed <> before")
    return changes.withColumn("until", F.lead("day").over(order)).filter("removed = 0").select(
        *key, F.col("day").alias("since"), "until"
    )


def _as_of(asked: DataFrame, intervals: DataFrame, first: object, last: object) -> DataFrame:
    """Entries active at (pattern, day), an inner join on pattern and month with the day inside the interval.

    Both sides are split by month, so one pattern meets no more rows at once than a month has days. Of an interval only the
    months from the ``first`` day asked about to the ``last`` are made, however far it reaches.
    """
    first, last = F.lit(first).cast("date"), F.lit(last).cast("date")
    held = intervals.filter((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
    months = held.withColumn("month", F.explode(F.sequence(
        _month(F.greatest("since", first)), _month(F.least(F.col("until"), last))
    )))
    found = asked.withColumn("asked_month", _month(F.col("day"))).join(
        months.withColumnRenamed("pattern", "listed"),
        (F.col("asked_pattern") == F.col("listed")) & (F.col("asked_month") == F.col("month"))
        & (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))),
    )
    return found.drop("asked_month", "month", "asked_pattern")


def _strongest(matches: DataFrame, rank: Column, *keys: str) -> DataFrame:
    """The entry that decides: the most specific, then a block before an allow, then the first list."""
    best = F.min(F.struct((-rank).alias("rank"), F.when(F.col("action") == "block", 0).otherwise(1).alias("kind"), "list", "listed", "since", "action"))
    return matches.groupBy(*keys).agg(best.alias("best"))


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """(id, verdict, list, pattern, since): what the lists of its day say about every capture.

    ``entries`` are (list, scope, pattern, action, day, event): scope ``host`` covers a host and everything below it, scope
    ``url`` one address; action is ``block`` or ``allow``; event is ``add`` or ``remove``. The most specific active entry
    decides, a block before an allow; without any the verdict is ``keep`` and the other columns are NULL.

    Verdicts depend on host, address and day alone. They are made once per distinct pair, so a host with a third of
    all captures asks once per day, and are joined back to the captures.

    NULL or relative URLs and NULL days match nothing. Days of entries may lie any time before or after all captures. Rows that repeat an id are judged alike. Other columns are ignored. An
    empty table on either side gives its plain result.
    """
    rows = captures.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), address_of(F.col(url_col)).alias("address"),
        F.col(day_col).cast("date").alias("day"),
    )
    rows = stage(rows, "captures")
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    intervals = stage(validity(entries), "validity")
    asked = rows.filter("day IS NOT NULL AND host <> ''")
    by_host = _as_of(
        asked.select("host", "day").distinct().withColumn("asked_pattern", F.explode(_suffixes(F.col("host")))),
        intervals.filter("scope = 'host'"), first, last,
    )
    hosts = stage(_strongest(by_host, F.size(F.split("listed", r"\.")), "host", "day"), "hosts")
    by_address = _as_of(
        asked.select("address", "day").distinct().withColumn("asked_pattern", F.col("address")), intervals.filter("scope = 'url'"), first, last
    )
    addresses = stage(_strongest(by_address, F.lit(EXACT), "address", "day"), "addresses")
    joined = (
        rows.join(hosts.withColumnRenamed("best", "of_host"), ["host", "day"], "left")
        .join(addresses.withColumnRenamed("best", "of_address"), ["address", "day"], "left")
    )
    best = F.coalesce("of_address", "of_host")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce(best["action"], F.lit("keep")).alias("verdict"), best["list"].alias("list"),
        best["listed"].alias("pattern"), best["since"].alias("since"),
    )

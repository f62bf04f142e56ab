"""URL lists as of a day, against a walk through the events; odd inputs."""

import datetime
import random

from pyspark.sql import functions as F

from gridprobe.llm import urls

DAY = datetime.date(2024, 1, 1)
ENTRIES = "list string, scope string, pattern string, action string, day date, event string"


def day(n):
    return DAY + datetime.timedelta(days=n)


def active(entries, scope, pattern, at):
    """(list, action, since) of entries that hold at a day."""
    found = []
    for key in {(e[0], e[3]) for e in entries if e[1] == scope and e[2] == pattern}:
        since = None
        mine = sorted({e[4] for e in entries if (e[0], e[3]) == key and e[1] == scope and e[2] == pattern and e[4] <= at})
        for d in mine:
            removed = any(e[5] == "remove" for e in entries if (e[0], e[3]) == key and e[1] == scope and e[2] == pattern and e[4] == d)
            since = None if removed else since or d
        if since:
            found.append((*key, since))
    return found


def plain(captures, entries):
    out = {}
    for i, host, address, at in captures:
        found = [(-1000, action != "block", name, address, since, action) for name, action, since in active(entries, "url", address, at)]
        parts = host.split(".")
        for k in range(len(parts)):
            pattern = ".".join(parts[k:])
            found += [(-(len(parts) - k), action != "block", name, pattern, since, action) for name, action, since in active(entries, "host", pattern, at)]
        best = min(found, default=None)
        out[i] = ("keep", None, None, None) if best is None else (best[5], best[2], best[3], best[4])
    return out


def test_against_a_walk_through_events(spark):
    rng = random.Random(5)
    hosts = ["a.example.org", "b.example.org", "example.org", "c.test", "x.y.z.test"]
    patterns = [("host", p) for p in [*hosts, "org", "test", "y.z.test"]] + [("url", f"{h}/p{k}") for h in hosts for k in range(3)]
    entries = [
        (rng.choice("LMN"), *rng.choice(patterns), rng.choice(("block", "allow")), day(rng.randrange(120)), rng.choice(("add", "remove")))
        for _ in range(400)
    ]
    captures = [(i, rng.choice(hosts), f"/p{rng.randrange(4)}", day(rng.randrange(-5, 150))) for i in range(500)]
    rows = spark.createDataFrame([(i, f"http://{h.upper()}:80{p}/#x", d) for i, h, p, d in captures], "page_id long, url string, fetched date")
    got = urls.judged(rows, spark.createDataFrame(entries, ENTRIES)).collect()
    wanted = plain([(i, h, h + p, d) for i, h, p, d in captures], entries)
    assert {r["page_id"]: tuple(r)[1:] for r in got} == wanted and len(got) == 500
    assert len({v[0] for v in wanted.values()}) == 3


def test_host_and_address(spark):
    given = {
        "HTTP://User:pw@Www.A.org.:8080/x/?q=1#f": ("www.a.org", "www.a.org/x/?q=1"), "https://a.org/": ("a.org", "a.org"), "mailto:x": ("", ""), "/rel": ("", ""),
        "http://a.org#f": ("a.org", "a.org"), "": ("", ""), "http://": ("", ""),
    }
    rows = spark.createDataFrame([(u,) for u in given], "url string").select(
        "url", urls.host_of(F.col("url")).alias("h"), urls.address_of(F.col("url")).alias("a")
    ).collect()
    assert {r["url"]: (r["h"], r["a"]) for r in rows} == given


def test_odd_captures(spark):
    schema = "page_id long, url string, fetched date, host string, day int, list string"
    rows = [(1, None, day(3), "h", 1, "l"), (2, "http://a.org", None, None, None, None), (None, "http://a.org/x", day(3), "h", 1, "l"),
            (3, "http://a.org/x", day(3), "h", 1, "l"), (3, "http://a.org/x", day(3), "h", 1, "l"), (4, "http://a.org/" + "x" * 100_000, day(3), "h", 1, "l")]
    entries = [("L", "host", "a.org", "block", day(3), "add"), ("L", "host", "a.org", "block", day(3), "add"), ("L", "host", None, "block", day(1), "add"),
               (None, "host", "a.org", "allow", day(1), "add"), ("M", "host", "a.org", "block", day(1), "add"), ("M", "host", "a.org", "block", day(1), "remove")]
    captures = spark.createDataFrame(rows, schema)
    got = urls.judged(captures, spark.createDataFrame(entries, ENTRIES)).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in got) == [(0, "block"), (1, "keep"), (2, "keep"), (3, "block"), (3, "block"), (4, "block")]
    none = urls.judged(captures, spark.createDataFrame([], ENTRIES)).collect()
    assert {r["verdict"] for r in none} == {"keep"} and len(none) == 6
    assert urls.judged(captures.filter("false"), spark.createDataFrame(entries, ENTRIES)).collect() == []


def test_far_days(spark):
    """Intervals from the first century and to the last make no more rows than the captures have months."""
    import datetime as dt

    captures = spark.createDataFrame([(d, f"http://{h}/x", day(d)) for d in (1, 40, 90) for h in ("a.org", "b.org", "c.org")], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([
        ("L", "host", "a.org", "block", dt.date(1, 1, 1), "add"), ("L", "host", "a.org", "block", dt.date(9999, 12, 31), "remove"),
        ("L", "host", "b.org", "block", dt.date(1, 1, 1), "add"), ("L", "host", "b.org", "block", day(40), "remove"),
        ("L", "host", "c.org", "block", day(41), "add"), ("M", "host", "c.org", "allow", dt.date(9999, 12, 31), "add"),
    ], ENTRIES)
    got = {(r["pattern"] or "", r["page_id"], r["verdict"]) for r in urls.judged(captures, entries).collect()}
    assert got == {("a.org", 1, "block"), ("a.org", 40, "block"), ("a.org", 90, "block"), ("b.org", 1, "block"), ("", 1, "keep"),
                   ("", 40, "keep"), ("", 90, "keep"), ("c.org", 90, "block")}
    asked = spark.createDataFrame([("a.org", day(1))], "asked_pattern string, day date")
    made = urls._as_of(asked, urls.validity(entries), day(1), day(90))
    assert made.count() == 1

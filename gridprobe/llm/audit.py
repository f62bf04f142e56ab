"""Filter interaction audit: id tables of failing rows, semi and anti joined for every prefix of every order."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprobe.llm.common import stage

# Keys with at least 1 / HOT of all rows are joined by broadcast: at most HOT of them.
HOT = 1_000
# Tables that grow with the rows are joined by merging. A planner takes their size from their files, and from before they
# are repeated for every prefix, and would send them through the driver.
MERGED = "merge"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text: too few words, too few distinct ones, too many capitals, odd signs."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def repeats(rows: DataFrame) -> DataFrame:
    """Rows (id, digest, ...) whose digest a smaller id has too; rows without an id never repeat another.

    Least ids are summed up per digest before they are shuffled, and only digests with two ids come back. Those
    that many rows share come back by broadcast, so that no task gathers their rows.
    """
    least = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("final"), F.count(F.lit(1)).alias("times"))
    shared = stage(least.filter("first < final").select("digest", "first", "times"), "repeated")
    enough = rows.count() / HOT
    hot = shared.filter(F.col("times") >= enough).select("digest", "first")
    rest = shared.filter(F.col("times") < enough).select("digest", "first")
    # What is hot leaves the rows before the others are shuffled.
    marked = rows.join(F.broadcast(hot), "digest", "left")
    often = marked.filter(F.col("id") > F.col("first")).drop("first")
    seldom = marked.filter("first IS NULL").drop("first").join(rest.hint(MERGED), "digest").filter(F.col("id") > F.col("first")).drop("first")
    return often.union(seldom.select(*often.columns))


def failing_ids(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id",
                text_col: str = "text") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The narrow table (row, id, part, good, toxic) of all rows, and for each filter A to E the written table
    of the rows that fail it.

    Rows are known by a number, written once, so rows that repeat an id stay apart. ``good`` and ``toxic`` are 1
    where any label row of the id says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = labels.select(F.col(id_col).alias("id"), "quality", "toxic").groupBy("id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    tested = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    tested = stage(
        tested.select("id", "part", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("digest"),
                      *[c.alias(f) for f, c in text_filters(F.col("text")).items()]),
        "tested",
    )
    rows = stage(
        tested.join(marks.hint(MERGED), "id", "left").fillna(0, ["good", "toxic"]), "rows"
    )
    keys = ["row", "part", "good", "toxic"]
    fails = {f: stage(rows.filter(f).select(*keys), f"fails-{f}") for f in "ABCD"}
    fails["E"] = stage(repeats(rows).select(*keys), "fails-E")
    return rows.select(*keys), fails


def prefix_relations(rows: DataFrame, fails: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What each set of filters that may come first does, as relations over (prefix, row).

    ``prefix`` is a set of filters as bits. ``blocked`` has a row for each filter of a prefix that the row fails.
    Survivors are the rows left by an anti join with it; of the rows that fail a filter outside the prefix, the
    semi join gives those that are gone already (redundant), the anti join those that the filter removes.
    Rows that fail nothing survive everything, so they are told apart by one more anti join and only counted.
    Every join is on (prefix, row), so no key is hot; nothing depends on the order within a prefix.
    """
    letters = sorted(fails)
    n = len(letters)
    every = None
    for i, letter in enumerate(letters):
        one = fails[letter].withColumns({"filter": F.lit(i), "own": F.lit(1 << i)})
        every = one if every is None else every.union(one)
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    own = F.col("own")
    blocked = every.select(
        "row", F.explode(F.filter(sets, lambda s: s.bitwiseAND(own) != 0)).alias("prefix")
    ).hint(MERGED)
    at_step = every.select(
        "*", F.explode(F.filter(sets, lambda s: s.bitwiseAND(own) == 0)).alias("prefix")
    )
    failing = every.select("row").hint(MERGED)
    at_risk = rows.join(failing, "row", "left_semi").select("*", F.explode(sets).alias("prefix"))
    on = ["prefix", "row"]
    return {
        "clean": rows.join(failing, "row", "left_anti"),
        "survivors": at_risk.join(blocked, on, "left_anti"),
        "removed": at_step.join(blocked, on, "left_anti"),
        "redundant": at_step.join(blocked, on, "left_semi"),
    }


def audited(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every
    value of ``part``, every order of the five filters and every step.

    NULL texts are empty, a NULL part is the empty one. Rows that repeat an id are rows of their own, with the
    same labels; the smaller id decides which of equal texts repeats, so rows with one id never repeat each
    other, and a row without an id has no labels and repeats none. Labels may repeat or lack ids and values.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows, fails = failing_ids(docs, labels, part, id_col, text_col)
    letters = sorted(fails)
    n = len(letters)
    found = prefix_relations(rows, fails)
    one = F.count(F.lit(1))
    step_counts = (
        found["removed"].groupBy("part", "filter", "own", "prefix")
        .agg(one.alias("removed"), F.lit(0).cast("long").alias("redundant"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
        .union(
            found["redundant"].groupBy("part", "filter", "own", "prefix")
            .agg(F.lit(0).cast("long"), one, F.lit(0).cast("long"), F.lit(0).cast("long"))
        )
    )
    # One entry per filter and prefix, so at most n * 2^(n - 1) of a part, whatever its size.
    names = ["removed", "redundant", "good_lost", "toxic_lost"]
    step_counts = step_counts.groupBy("part", "filter", "own", "prefix").agg(*[F.sum(c).alias(c) for c in names])
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("prefix") + 1)
    others = F.lit((1 << n) - 1) - F.col("own")
    by_filter = step_counts.groupBy("part", "filter").agg(
        F.sum(weight * F.col("removed")).alias("shapley"),
        F.sum(F.when(F.col("prefix") == others, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.map_from_entries(F.collect_list(F.struct("prefix", F.struct(*names)))).alias("at"),
    )
    by_part = by_filter.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("filter", F.struct("shapley", "unique_fails", "at")))).alias("filters")
    )
    kept = (
        found["survivors"].groupBy("part", "prefix").agg(one.alias("n"))
        .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "n"))).alias("remaining"))
    )
    parts = rows.groupBy("part").agg(one.alias("total"))
    clean = found["clean"].groupBy("part").agg(one.alias("clean"))
    joined = parts.join(clean, "part", "left").join(kept, "part", "left").join(by_part, "part", "left")

    steps = F.array(*[
        F.struct(
            F.lit("".join(letters[i] for i in order)).alias("filter_order"), F.lit(k + 1).alias("step"),
            F.lit(order[k]).alias("filter"), F.lit(sum(1 << i for i in order[:k])).alias("before"),
            F.lit(sum(1 << i for i in order[: k + 1])).alias("after"),
        )
        for order in permutations(range(n)) for k in range(n)
    ])
    rolled = joined.select("part", "clean", "remaining", "filters", F.explode(steps).alias("s")).select("*", "s.*")
    mine = F.col("filters")[F.col("filter")]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    at = mine["at"][F.col("before")]
    return rolled.select(
        "part", "filter_order", "step",
        (count(F.col("clean")) + count(F.col("remaining")[F.col("after")])).alias("kept"),
        *[count(at[c]).alias(c) for c in ("removed", "redundant")],
        count(mine["unique_fails"]).alias("unique_fails"),
        *[count(at[c]).alias(c) for c in ("good_lost", "toxic_lost")],
        count(mine["shapley"]).alias("shapley"),
    )

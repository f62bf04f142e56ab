"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridprobe.llm.common import WORD_PATTERN, release, stage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3
# Newton steps per job, and the relative gap at which the dual counts as solved.
STEPS = 4
MAX_STEPS = 80
GAP = 1e-9
# Rates are rounded to this part of a copy, so that running sums are exact integers.
UNIT = 1 << 20
# Documents of one source and size are ranked in groups of about so many.
RANKED = 256
# Sizes per block of the two-level running sums.
BLOCK = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(cells: DataFrame) -> DataFrame:
    """One row per source: its place in code-point order (NULL last), size, and target.

    Weights repeat along the order. A target stops at ``MAX_RATE`` times its source's size and the excess
    goes to the others by weight. That water level is closed-form: with sources sorted by cap over weight,
    the capped ones are a prefix.
    """
    total = F.sum(F.col("n") * F.col("size"))
    sources = cells.groupBy("source").agg(
        total.alias("source_size"), F.sum("n").alias("source_docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
    )
    # One row per source, so these windows do not grow with the documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    ranked = (
        sources.withColumn("source_no", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(MAX_RATE))
        .withColumn("level_at_cap", F.col("cap") / F.col("weight"))
    )
    by_level = Window.orderBy("level_at_cap", "source_no")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    # The first source that the level, shared by it and all later ones, does not fill gives the final level.
    open_ = F.when(F.col("level") <= F.col("level_at_cap"), F.struct("level_at_cap", "source_no"))
    final = F.min_by("level", open_)
    return (
        levels.withColumn("final_level", final.over(everything))
        .withColumn("target", F.least("cap", F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap"))))
        .select("source_no", "source", "source_size", "source_docs", "least_size", "target")
    )


def _solved(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the multiplier of its token constraint.

    The problem is to find rates r >= 0 of least relative entropy sum(r log r - r) with sum(r size) = target
    and r <= MAX_RATE. Its solution is r = min(MAX_RATE, exp(lam z)) with z = size over the mean size, and lam
    is the root of an increasing function of one variable per source. Newton steps run for all sources at
    once, one aggregation over the cells each; a step that leaves the bracket is replaced by its middle. Sums
    are decimals, so they do not depend on the order of rows.
    """
    ln_cap = F.log(F.lit(float(MAX_RATE)))
    z_least = F.col("least_size") * F.col("source_docs") / F.col("source_size")
    growing = F.col("target") > F.col("source_size")
    state = targets.filter("source_size > 0 AND target > 0").select(
        "source_no", "target", "source_size", "source_docs",
        F.when(growing, 0.0).otherwise(F.log(F.col("target") / F.col("source_size")) / z_least).alias("lo"),
        F.when(growing, ln_cap / z_least).otherwise(0.0).alias("hi"),
        F.when(F.col("target") >= F.col("source_size") * (MAX_RATE * (1 - 1e-12)), ln_cap / z_least)
        .otherwise(0.0).alias("lam"),
        F.lit(1.0).alias("gap"),
    )
    state = stage(state, "balance")
    for _ in range(0, MAX_STEPS, STEPS):
        step = state
        for _ in range(STEPS):
            z = F.col("size") * F.col("source_docs") / F.col("source_size")
            rate = F.least(F.exp(F.col("lam") * z), F.lit(float(MAX_RATE)))
            tokens = F.col("n") * F.col("size")
            exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
            sums = (
                cells.join(step, "source_no")
                .groupBy("source_no")
                .agg(
                    exact(tokens * rate).alias("got"),
                    exact(F.when(rate < MAX_RATE, tokens * z * rate).otherwise(0.0)).alias("slope"),
                )
            )
            excess = F.col("got") - F.col("target")
            lo = F.when(excess < 0, F.col("lam")).otherwise(F.col("lo"))
            hi = F.when(excess > 0, F.col("lam")).otherwise(F.col("hi"))
            newton = F.col("lam") - excess / F.col("slope")
            inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
            gap = F.abs(excess) / F.col("target")
            step = step.join(sums, "source_no").select(
                "source_no", "target", "source_size", "source_docs", lo.alias("lo"), hi.alias("hi"),
                F.when(gap <= GAP, F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2).alias("lam"),
                gap.alias("gap"),
            )
        following = stage(step, "balance")
        release(state)
        state = following
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= GAP:
            break
    return state.select("source_no", "lam")


def _running(df: DataFrame, value: Column, name: str, descending: bool) -> DataFrame:
    """Adds the sum of ``value`` over the cells of the same source that come before, in order of size.

    Two levels, first over blocks of sizes, so that no task orders all cells of a source.
    """
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    marked = df.withColumn("_value", value).withColumn("_block", F.floor(F.col("size") / BLOCK))
    blocks = marked.groupBy("source_no", "_block").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy("source_no").orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source_no", "_block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("source_no", "_block").orderBy(way("size")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.join(starts, ["source_no", "_block"])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .drop("_value", "_block", "_start")
    )


def _copies(cells: DataFrame, targets: DataFrame, solved: DataFrame) -> DataFrame:
    """Whole copies per cell.

    Rates are rounded along the sizes from large to small, each cell taking what its running sum of copies
    gains. What a source then lacks or has too much of, twice its largest document at most, is added to or
    taken from its smallest documents, a copy each, so that the source ends within one small document.
    """
    z = F.col("size") * F.col("source_docs") / F.col("source_size")
    rated = cells.join(targets.drop("source", "least_size"), "source_no").join(solved, "source_no", "left").withColumn(
        "rate", F.when(F.col("lam").isNull(), 0.0).otherwise(F.least(F.exp(F.col("lam") * z), F.lit(float(MAX_RATE))))
    )
    parts = F.col("n") * F.round(F.col("rate") * UNIT).cast("long")
    first = _running(rated, parts, "_before", descending=True)
    # div keeps integers exact where a quotient of doubles would not.
    at = lambda c: F.call_function("div", c + F.lit(UNIT // 2), F.lit(UNIT))
    rounded = stage(first.withColumn("copies", at(F.col("_before") + parts) - at(F.col("_before"))).drop("_before"), "rounded")
    taken = rounded.groupBy("source_no").agg(F.sum(F.col("copies") * F.col("size")).alias("_taken"))
    short = rounded.join(taken, "source_no").withColumn("_short", F.round("target").cast("long") - F.col("_taken"))
    room = F.when(F.col("size") == 0, F.lit(0)).when(F.col("_short") > 0, MAX_RATE * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    placed = _running(short, room * F.col("size"), "_used", descending=False)
    left = F.greatest(F.abs("_short") - F.col("_used"), F.lit(0))
    moved = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(room, F.call_function("div", left, F.greatest("size", F.lit(1)))))
    return placed.withColumn("copies", F.col("copies") + F.signum("_short").cast("long") * moved).select(
        "source_no", "size", "n", "source_size", "target", "rate", "copies"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document enters a mix in which sources have given shares of the words.

    Returns (id, size, source_size, target, taken, copies, rate), one row per input row; ``taken`` is
    copies times size. Sizes are words of the whole text. Work on documents is confined to counting words, a
    count per (source, size), and handing copies to rows, since rates depend on source and size alone; so a
    source with a third of all rows is no larger a group than any other. Equal documents are told apart by a
    hash of their id, in ranked groups of about ``RANKED`` rows.

    NULL or empty texts have size 0 and take 0. A NULL source is a source of its own, last in order. Rows
    with equal ids are separate documents. A NULL id is ranked like any other. An empty table gives an empty
    result. Other columns are ignored. Reruns give the same rows.
    """
    sized = stage(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")),
        "sizes",
    )
    per_source = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    per_source = stage(per_source, "cells")
    targets = stage(source_targets(per_source), "targets")
    same_source = F.col("c.source").eqNullSafe(F.col("t.source"))
    cells = stage(
        per_source.alias("c").join(targets.alias("t"), same_source)
        .select("t.source_no", "c.size", "c.n"),
        "cells",
    )
    copies = stage(_copies(cells, targets, _solved(cells, targets)), "copies")
    known = copies.join(targets.select("source_no", "source"), "source_no").select(
        "source_no", F.col("source").alias("cell_source"), F.col("size").alias("cell_size"), "source_size", "target", "rate",
        F.call_function("div", F.col("copies"), F.col("n")).alias("base"), (F.col("copies") % F.col("n")).alias("extra"),
        F.ceil(F.col("n") / RANKED).alias("groups"),
    )
    placed = sized.join(
        known, sized["source"].eqNullSafe(known["cell_source"]) & (sized["size"] == known["cell_size"])
    ).withColumn("mark", F.xxhash64(F.lit("mix"), "id")).withColumn("group", F.pmod("mark", F.col("groups")))
    # Ranks within a cell: the place in the group, behind the rows of the groups before it.
    cell = ["source_no", "cell_size"]
    groups = placed.groupBy(*cell, "group").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*cell).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(*cell, "group", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inner = Window.partitionBy(*cell, "group").orderBy("mark", "id")
    ranked = placed.join(starts, [*cell, "group"]).withColumn("place", F.row_number().over(inner))
    number = F.col("base") + F.when(F.col("start") + F.col("place") <= F.col("extra"), 1).otherwise(0)
    return ranked.select(
        F.col("id").alias(id_col), F.col("cell_size").alias("size"), "source_size", F.col("target").cast("double"),
        (number * F.col("cell_size")).cast("long").alias("taken"), number.cast("long").alias("copies"), "rate",
    )

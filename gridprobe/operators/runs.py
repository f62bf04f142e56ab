"""Scans along a run's step order that stay balanced when one run holds most of the rows.

A run is cut into chunks of consecutive steps. A chunk has at most ``CHUNK_STEPS`` rows because steps
are unique inside a run. What crosses chunk borders is carried by a table of chunk summaries, which is
``CHUNK_STEPS`` times smaller than the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridprobe.operators import metrics
from gridprobe.operators.grid import floor_div

CHUNK_STEPS = 65_536


def _chunk_of(step: Column, size: int) -> Column:
    return floor_div(step, size).cast("bigint")


def early_stopping(
    df: DataFrame, run: str, step: str, score: str, patience: int = 256, negate: bool = False,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Where each run stops: one row per run.

    Evaluations count in step order. An evaluation that beats the best so far strictly resets the
    boredom, any other adds one. The run stops at the evaluation after boredom reaches ``patience``
    and keeps the best score up to there. ``stop_step`` is NULL for a run that never stops. A NaN score is
    an error.

    The log is shuffled once, by run and chunk. The best of a chunk can only be the first row that
    reaches its maximum, so chunk summaries hold all that later chunks need to know.
    """
    given = metrics.not_nan(F.col(score).cast("double"))
    value = -given if negate else given
    log = df.select(
        run, F.col(step).alias("_step"), value.alias("_v"),
        _chunk_of(F.col(step), chunk_steps).alias("_chunk"),
    )
    # Stated here, so that both readers below have the same filter and share one shuffle.
    log = log.filter(F.col(run).isNotNull() & F.col("_chunk").isNotNull())
    here = Window.partitionBy(run, "_chunk").orderBy("_step")
    log = log.withColumn("_place", F.row_number().over(here))

    peak = F.min_by(F.struct("_v", "_place", "_step"), F.struct(-F.col("_v"), F.col("_place")))
    chunks = log.groupBy(run, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), peak.alias("_peak"), F.min("_step").alias("_first")
    )
    in_run = Window.partitionBy(run).orderBy("_chunk")
    earlier = in_run.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({
        "_rows_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
        "_top_before": F.max("_peak._v").over(earlier),
        "_next_chunk": F.lead("_first").over(in_run),
    })
    beats = F.col("_top_before").isNull() | (F.col("_peak._v") > F.col("_top_before"))
    best = F.struct((F.col("_rows_before") + F.col("_peak._place")).alias("i"), F.col("_peak._step").alias("step"),
                    F.col("_peak._v").alias("v"))
    chunks = chunks.withColumn("_best", F.when(beats, best)).withColumn("_best_before", F.max("_best").over(earlier))
    borders = chunks.select(run, "_chunk", "_rows_before", "_top_before", "_next_chunk", "_best_before")

    log = log.join(borders, [run, "_chunk"])
    log = log.withColumns({
        "_i": F.col("_rows_before") + F.col("_place"),
        "_top": F.max("_v").over(here.rowsBetween(Window.unboundedPreceding, -1)),
        "_next": F.coalesce(F.lead("_step").over(here), F.col("_next_chunk")),
    })
    previous = F.greatest("_top", "_top_before")
    current = F.struct(F.col("_i").alias("i"), F.col("_step").alias("step"), F.col("_v").alias("v"))
    log = log.withColumn("_mine", F.when(previous.isNull() | (F.col("_v") > previous), current))
    log = log.withColumn("_best", F.coalesce(F.max("_mine").over(here), F.col("_best_before")))
    bored = F.col("_i") - F.col("_best.i") == patience
    outcome = log.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_evals"),
        F.min_by(F.struct("_i", "_next", "_best"), F.when(bored, F.col("_i"))).alias("_stop"),
        F.max("_best").alias("_final"),
    )
    kept = F.coalesce("_stop._best", "_final")
    return outcome.select(
        run, "n_evals", F.coalesce("_stop._i", "n_evals").alias("n_used"), F.col("_stop._next").alias("stop_step"),
        kept["step"].alias("best_step"), (-kept["v"] if negate else kept["v"]).alias("best_score"),
    )


def first_of_each_stretch(df: DataFrame, order: str, category: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Rows whose category differs from the row before, in the order of a unique integer.

    Rows look back inside their chunk; a chunk's first row looks at the last category of the nearest
    chunk before it. NULL is a category like any other.
    """
    chunk = _chunk_of(F.col(order), chunk_steps)
    log = df.withColumn("_chunk", chunk).filter(F.col("_chunk").isNotNull())
    here = Window.partitionBy("_chunk").orderBy(order)
    # In a struct, a NULL category differs from there being no row.
    log = log.withColumn("_category", F.struct(F.col(category).alias("value")))
    log = log.withColumns({"_place": F.row_number().over(here), "_prev": F.lag("_category").over(here)})
    # Read from the sorted log, which both branches share.
    ends = log.groupBy("_chunk").agg(F.max_by("_category", order).alias("_end"))
    # Chunk ends are scanned in groups too; a second summary carries the last end across groups.
    ends = ends.withColumn("_group", _chunk_of(F.col("_chunk"), chunk_steps))
    inside = Window.partitionBy("_group").orderBy("_chunk")
    tops = ends.groupBy("_group").agg(F.max_by("_end", "_chunk").alias("_top"))
    across = tops.select("_group", F.lag("_top").over(Window.orderBy("_group")).alias("_far"))
    borders = (
        ends.withColumn("_near", F.lag("_end").over(inside))
        .join(across, "_group")
        .select("_chunk", F.coalesce("_near", "_far").alias("_border"))
    )
    joined = log.join(borders, "_chunk")
    previous = F.when(F.col("_place") == 1, F.col("_border")).otherwise(F.col("_prev"))
    kept = joined.withColumn("_before", previous).filter(
        F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col(category))
    )
    return kept.select(*df.columns)

"""Fitted scalings. Statistics reach the rows as scalar subqueries, so each plan stays one plan."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import vectors
from gridprobe.functions.signal import widen

# Tasks merge their partial statistics in this many groups before the groups merge.
FAN_IN = 64


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale a numeric column to [0, 1] over the whole table, as FLOAT; a constant becomes 0."""
    wide = F.col(column).cast("double")
    range_ = df.agg(F.struct(F.min(wide).alias("lo"), F.max(wide).alias("hi")).alias("r")).scalar()
    low, high = range_["lo"], range_["hi"]
    scaled = F.when(high == low, 0.0).otherwise((wide - low) / (high - low))
    return df.withColumn(name, scaled.cast("float"))


def _vector_sum(parts: Column, term) -> Column:
    """Element-wise sum of ``term(part)`` over an array of parts."""
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(
        rest, term(parts[0]), lambda acc, part: F.zip_with(acc, term(part), lambda a, b: a + b)
    )


def dimension_stats(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Row count, mean and population deviation per dimension as arrays, one row per group.

    The summariser folds whole vectors inside each task, so one partial per task and group is
    shuffled instead of one row per element. The partials meet in two rounds: first in ``FAN_IN``
    buckets of tasks, then the few bucket results are merged, so that no task reads the partials of
    every other task.
    """
    vector = array_to_vector(widen(F.col(column)))
    bucketed = df.withColumn("_bucket", F.spark_partition_id() % FAN_IN).groupBy(*by, "_bucket").agg(
        Summarizer.metrics("count", "mean", "variance").summary(vector).alias("s")
    )
    n = F.col("s.count")
    # The summariser divides by n - 1; squared sums are what merges.
    squares = F.transform(vector_to_array(F.col("s.variance")), lambda v: v * (n - 1))
    part = F.struct(n.alias("n"), vector_to_array(F.col("s.mean")).alias("mean"), squares.alias("squares"))
    merged = bucketed.select(*by, part.alias("p")).groupBy(*by).agg(
        F.collect_list("p").alias("_parts"), F.sum("p.n").alias("n")
    )
    means = _vector_sum(F.col("_parts"), lambda p: F.transform(p["mean"], lambda m: m * p["n"]))
    merged = merged.withColumn("means", means).withColumn("means", F.transform("means", lambda m: m / F.col("n")))

    def about_mean(p: Column) -> Column:
        shift = F.zip_with(p["mean"], F.col("means"), lambda a, b: (a - b) * (a - b) * p["n"])
        return F.zip_with(p["squares"], shift, lambda a, b: a + b)

    spread = _vector_sum(F.col("_parts"), about_mean)
    return merged.withColumn("_spread", spread).select(
        *by, "n", "means", F.transform("_spread", lambda v: F.sqrt(v / F.col("n"))).alias("deviations")
    )


def standardise(df: DataFrame, column: str, name: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise a vector column with statistics of ``fit_on`` (by default the table itself)."""
    source = df if fit_on is None else fit_on
    stats = dimension_stats(source, column).select(F.struct("means", "deviations").alias("s")).scalar()
    return (
        df.withColumn("_s", stats)
        .withColumn(name, vectors.standardised(F.col(column), F.col("_s.means"), F.col("_s.deviations")))
        .drop("_s")
    )

"""Probe metrics over (label, logits) or (label, prediction) rows.

Every metric is a plain aggregate, so it combines inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import vectors


def _mean_of(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def classification(df: DataFrame, label: str, logits: str, *by: str) -> DataFrame:
    """Rows, accuracy, micro F1 and cross-entropy per group, in one pass."""
    scored = df.withColumn("_pred", vectors.argmax(F.col(logits))).withColumn(
        "_loss", vectors.cross_entropy(F.col(logits), F.col(label))
    )
    hit = (F.col("_pred") == F.col(label)).cast("bigint")
    counted = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("_tp"), F.avg("_loss").alias("loss")
    )
    # Every miss is one false positive and one false negative when summed over the classes.
    missed = F.col("n") - F.col("_tp")
    f1 = F.try_divide(F.col("_tp"), F.col("_tp") + (missed + missed) / 2)
    accuracy = F.try_divide(F.col("_tp"), F.col("n"))
    return counted.select(
        *by, "n", "loss", accuracy.alias("accuracy"), f1.alias("f1"),
        accuracy.alias("primary_eval_metric"), accuracy.alias("primary"),
    )


def accuracy(df: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(_mean_of(F.col(label) == F.col(prediction)).alias("accuracy"))


def micro_f1(df: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    """F1 from true positives, false positives and false negatives summed over all classes."""
    sides = F.array(
        F.struct(F.lit("label").alias("side"), F.col(label).alias("class")),
        F.struct(F.lit("prediction").alias("side"), F.col(prediction).alias("class")),
    )
    per_class = (
        df.select(*by, (F.col(label) == F.col(prediction)).alias("_hit"), F.explode(sides).alias("_s"))
        .groupBy(*by, F.col("_s.class").alias("_class"))
        .agg(
            F.count_if((F.col("_s.side") == "label") & F.col("_hit")).alias("tp"),
            F.count_if((F.col("_s.side") == "prediction") & ~F.col("_hit")).alias("fp"),
            F.count_if((F.col("_s.side") == "label") & ~F.col("_hit")).alias("fn"),
        )
    )
    summed = per_class.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1 = F.try_divide(F.col("tp"), F.col("tp") + (F.col("fp") + F.col("fn")) / 2)
    return summed.select(*by, "tp", "fp", "fn", f1.alias("f1"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) for every pair of values present on either side, zeros included.

    The list of present values comes from the counted pairs, so it is as short as the class domain.
    """
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    present = counts.select(F.explode(F.array("label", "prediction")).alias("v")).agg(
        F.sort_array(F.collect_set("v")).alias("values")
    )
    cells = present.select(F.explode("values").alias("label"), "values").select(
        "label", F.explode("values").alias("prediction")
    )
    return cells.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def regression(df: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    """Rows, mean squared error and R2 per group, in one pass.

    The total sum of squares is the population variance times n, which the engine accumulates
    without cancellation. A constant label has no R2.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("loss"), F.var_pop(y).alias("_spread")
    )
    r2 = 1 - F.try_divide(F.col("loss"), F.nullif(F.col("_spread"), F.lit(0.0)))
    return sums.select(
        *by, "n", "loss", r2.alias("r2"), r2.alias("primary_eval_metric"), r2.alias("primary")
    )


def best_per(df: DataFrame, metric: str, config: list[str], *by: str) -> DataFrame:
    """The configuration with the highest metric per group; equal metrics go to the smallest one.

    One pass: each task keeps one record per group. A metric that is NULL or NaN never wins, and a group
    without any other has no row.
    """
    value = F.col(metric).cast("double")
    scored = df.filter(value.isNotNull() & ~F.isnan(value))
    first = F.min_by(F.struct(metric, *config), F.struct(-value, *config)).alias("_c")
    return scored.groupBy(*by).agg(first).select(*by, "_c.*")


def not_nan(score: Column) -> Column:
    """The score; a NaN fails the job."""
    return F.when(F.isnan(score), F.raise_error(F.lit("NaN score")).cast("double")).otherwise(score)


def reject_nan(df: DataFrame, score: str) -> DataFrame:
    """Fail the job on a NaN score."""
    return df.withColumn(score, not_nan(F.col(score)))

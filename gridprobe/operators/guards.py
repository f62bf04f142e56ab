"""Checks on tables: counts, uniqueness, shapes and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import signal, vectors


def check_row_counts(table: DataFrame, store: DataFrame) -> int:
    """The common row count of a dataset table and its embeddings; a mismatch is an error."""
    rows, vectors_ = table.count(), store.count()
    if rows != vectors_:
        raise RuntimeError(f"the table has {rows} rows but the store has {vectors_}")
    return rows


def uniqueness(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Rows, distinct values and whether they agree, per group."""
    # Counting per value first spreads a hot group over its values.
    per_value = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count(column).alias("n_distinct")
    ).withColumn("is_unique", F.col("n") == F.col("n_distinct"))


def dimension_range(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Shortest and longest vector per group; a sound store has one length."""
    size = F.size(column)
    return df.groupBy(*by).agg(
        F.min(size).alias("min_dim"), F.max(size).alias("max_dim")
    ).withColumn("is_uniform", F.col("min_dim") == F.col("max_dim"))


def blank_counts(df: DataFrame, column: str, *by: str) -> DataFrame:
    """All-zero vectors per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(vectors.is_blank(F.col(column))).alias("n_blank")
    )


def silent_count(df: DataFrame, flag: str = "is_silent") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("n_silent"))


def split_rejects(df: DataFrame, fits: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); a row whose check is NULL is rejected."""
    sound = F.coalesce(fits, F.lit(False))
    return df.filter(sound), df.filter(~sound)


def too_short(df: DataFrame, n_samples: Column, rate: Column | int, minimum_seconds: float) -> DataFrame:
    """Rows below the minimum duration, with their duration."""
    seconds = signal.seconds(n_samples, rate)
    return df.withColumn("seconds", seconds).filter(F.col("seconds") < minimum_seconds)


def outside_midi_range(df: DataFrame, note: str) -> DataFrame:
    return df.filter(~F.col(note).between(0, 127))

"""Shards, their status, and what each run needs next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import fixed_values as fv
from gridprobe.operators.grid import floor_div

NEVER_STARTED, IN_PROGRESS, DONE, FAILED = "never started", "in progress", "done", "failed"


def shard_of(row_id: Column, max_samples: int = fv.SAMPLES_PER_SHARD) -> Column:
    return floor_div(row_id, max_samples).cast("int")


def total_shards(n: int, max_samples: int = fv.SAMPLES_PER_SHARD) -> int:
    return -(-n // max_samples)


def shard_sizes(n: int, max_samples: int = fv.SAMPLES_PER_SHARD) -> list[int]:
    """Full shards, then the remainder if there is one."""
    full, rest = divmod(n, max_samples)
    return [max_samples] * full + ([rest] if rest else [])


def shard_counts(df: DataFrame, row_id: str, max_samples: int = fv.SAMPLES_PER_SHARD) -> DataFrame:
    """Rows per shard as they are in a table."""
    return df.groupBy(shard_of(F.col(row_id), max_samples).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def check_shard_count(reported: int, n: int, max_samples: int) -> None:
    if reported != total_shards(n, max_samples):
        raise RuntimeError(f"{reported} shards are recorded but {n} rows need {total_shards(n, max_samples)}")


def elapsed_hours(since: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", since, now) / 3600


def latest_status(
    log: DataFrame, shards: DataFrame, now: Column, by: list[str], ts: str = "ts", tie: str | None = None,
    stale_hours: float = fv.STALE_SHARD_HOURS,
) -> DataFrame:
    """Every shard with its present status.

    The latest log row wins. Work in progress for longer than ``stale_hours`` counts as failed, and a
    shard without log rows never started. ``max_by`` keeps one row per task and shard.
    """
    order = F.struct(ts, tie) if tie else F.col(ts)
    last = log.groupBy(*by).agg(F.max_by(F.struct("status", ts), order).alias("_l"))
    status, since = F.col("_l.status"), F.col(f"_l.{ts}")
    stale = (status == IN_PROGRESS) & (elapsed_hours(since, now) > stale_hours)
    joined = shards.join(last, by, "left")
    return joined.select(
        *shards.columns,
        F.when(status.isNull(), NEVER_STARTED).when(stale, FAILED).otherwise(status).alias("status"),
    )


def plan_runs(run_grid: DataFrame, statuses: DataFrame, by: list[str]) -> DataFrame:
    """The next action of every run.

    A run without any started shard is to be extracted; one with failed shards is to be repaired;
    otherwise it is done, or still running.
    """
    one = F.lit(1)
    counted = statuses.groupBy(*by).agg(
        F.count(one).alias("n_shards"),
        F.count_if(F.col("status") == FAILED).alias("n_failed"),
        F.count_if(F.col("status") == IN_PROGRESS).alias("n_in_progress"),
        F.count_if(F.col("status") == DONE).alias("n_done"),
    )
    started = F.col("n_failed") + F.col("n_in_progress") + F.col("n_done")
    counts = ["n_shards", "n_failed", "n_in_progress", "n_done"]
    joined = run_grid.join(counted, by, "left").fillna(0, counts)
    action = (
        F.when(started == 0, "extract").when(F.col("n_failed") > 0, "repair")
        .when(F.col("n_done") == F.col("n_shards"), "done").otherwise("wait")
    )
    return joined.withColumn("action", action)


def failed_shards(statuses: DataFrame) -> DataFrame:
    """The shards to run again, one row each."""
    return statuses.filter(F.col("status") == FAILED).drop("status")

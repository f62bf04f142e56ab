"""Mean and deviation per dimension, kept up to date as vectors arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridprobe.functions.signal import widen
from gridprobe.sources import sinks


def dimension_stats(stream: DataFrame, column: str) -> DataFrame:
    """(dim, n, mean, deviation). The state is one mergeable triple per dimension, whatever arrives.

    The aggregates combine inside each task, so a batch sends one row per task and dimension.
    """
    cells = stream.select(F.posexplode(widen(F.col(column))).alias("dim", "x"))
    return cells.groupBy("dim").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation")
    )


def value_stats(stream: DataFrame, value: str, *by: str) -> DataFrame:
    return stream.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation")
    )


def keep_latest(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the whole statistics table after every batch, one folder per batch id.

    The folder of a replayed batch is replaced, so a restart never mixes two versions. The version before stays
    for readers that have begun; older ones go.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        sinks.delete(batch.sparkSession, f"{path}/batch_id={batch_id - 2}")

    return (
        stats.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )


def read_latest(spark, path: str) -> DataFrame:
    """The newest complete version."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("batch_id")).first()[0]
    return versions.filter(F.col("batch_id") == newest).drop("batch_id")

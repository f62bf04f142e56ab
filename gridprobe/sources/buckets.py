"""Tables stored in buckets by row id: joins of two need no shuffle, and a batch reads only its buckets."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.operators import permutation
from gridprobe.sources import sinks

SPEC = "buckets.json"


def publish(df: DataFrame, path: str, buckets: int, key: str = "row_id") -> None:
    """Write a table once, one sorted file per bucket of ``key``.

    Choose the same ``buckets`` for tables that will be joined, so many that one bucket suits a task. An existing target
    is an error. Files are built beside the target and renamed when they and their description are complete.
    """
    spark = df.sparkSession
    if sinks.exists(spark, path):
        raise RuntimeError(f"a table exists already at {path}")
    if df.filter(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} is NULL in some rows")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    name = f"gridprobe_{uuid.uuid4().hex}"
    try:
        # The shuffle deals rows as the buckets do, so that each is one file.
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{staging}/rows").format("parquet").saveAsTable(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files are not the catalog's
        columns = [[f.name, f.dataType.simpleString()] for f in df.schema]
        sinks.save_json(spark, f"{staging}/{SPEC}", {"buckets": buckets, "key": key, "columns": columns, "rows": spark.read.schema(df.schema).parquet(f"{staging}/rows").count()})
        sinks.move(spark, staging, path)
    finally:
        sinks.delete(spark, staging)


def spec(spark: SparkSession, path: str) -> dict:
    return json.loads(sinks.read_text(spark, f"{path.rstrip('/')}/{SPEC}"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table with its buckets, which any session may read: they are declared again from the description."""
    found = spec(spark, path)
    name = f"gridprobe_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    columns = ", ".join(f"`{column}` {kind}" for column, kind in found["columns"])
    location = f"{path.rstrip('/')}/rows".replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{found['key']}`) SORTED BY (`{found['key']}`) "
        f"INTO {found['buckets']} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def joined(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of both tables by key, merged bucket by bucket: neither side is shuffled or sent to all tasks."""
    return left.hint("merge").join(right, key)


def random_batch(spark: SparkSession, path: str, size: int, step: int, seed: int = 0) -> DataFrame:
    """The rows of one training step: ``size`` rows without repetition, all rows of the table once per epoch.

    Keys must be 0 .. n - 1. The batch's keys follow from the step by a keyed permutation; they are as many as
    the batch, and only the buckets that hold one are read.
    """
    found = spec(spark, path)
    n = found["rows"]
    table = read(spark, path)
    if not n:
        return table
    epoch, first, stop = permutation.batch_range(n, size, step)
    keys = spark.range(first, stop).select(permutation.permuted(F.col("id"), n, seed + epoch).alias("k")).collect()
    return table.filter(F.col(found["key"]).isin([r["k"] for r in keys]))

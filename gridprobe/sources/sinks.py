"""Writers: write-once tables, embedding stores, logs and metrics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridprobe.functions.hashing import canonical_json, checksum, config_checksum


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return hadoop, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, target, fs = _fs(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    _, target, fs = _fs(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def delete(spark: SparkSession, path: str) -> bool:
    _, target, fs = _fs(spark, path)
    return fs.delete(target, True)


def list_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths that match a glob. Exports are one folder per concept and model, so the list is short."""
    hadoop, _, fs = _fs(spark, pattern)
    found = fs.globStatus(hadoop.Path(pattern)) or []
    return spark.createDataFrame([(s.getPath().toString(),) for s in found], "path string")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _, target, fs = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def create_from(spark: SparkSession, source: str, target: str) -> bool:
    """Give a complete file a name, if that name is free; of several who try at once one succeeds."""
    hadoop, old, fs = _fs(spark, source)
    _, new, _ = _fs(spark, target)
    fs.mkdirs(new.getParent())
    if fs.getScheme() != "file":
        return fs.rename(old, new)
    # A local rename would replace the target; a link to a name that is taken fails.
    files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
    try:
        files.createLink(paths.get(new.toUri().getPath(), _strings(spark)), paths.get(old.toUri().getPath(), _strings(spark)))
    except Exception as problem:
        if "FileAlreadyExists" in str(problem):
            return False
        raise
    return True


def _strings(spark: SparkSession):
    return spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def ordered(df: DataFrame, row_id: str = "row_id", files: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by row id: files do not overlap, so id ranges prune.

    Without a number of files, ``spark.sql.shuffle.partitions`` decides.
    """
    spread = df.repartitionByRange(files, row_id) if files else df.repartitionByRange(row_id)
    return spread.sortWithinPartitions(row_id)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a finished file or folder to a name that is still free."""
    _, old, fs = _fs(spark, source)
    _, new, _ = _fs(spark, target)
    fs.mkdirs(new.getParent())
    if exists(spark, target) or not fs.rename(old, new):
        raise RuntimeError(f"could not move the finished table to {target}")


def publish(
    df: DataFrame, path: str, row_id: str | None = "row_id", files: int | None = None,
    check: Callable[[DataFrame], None] | None = None, counts: Mapping[str, Column] | None = None,
    where: Column | None = None,
) -> dict[str, int]:
    """Write a table once.

    An existing target is an error. Files are built beside the target and renamed when they are
    complete; after a failure the staging folder is removed and no target appears. ``check`` sees the
    finished files before they are published and may raise.

    ``counts`` are named aggregates that the first write observes as the rows pass, and that are returned; nothing
    is read again for them. Rows for which ``where`` does not hold are counted with the others and not written.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise RuntimeError(f"a table exists already at {path}")
    # A name of its own, so that two publishers of one path do not mix their files.
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    seen = Observation()
    if counts:
        # The last step before the rows are written, so that a task which is run again counts once.
        df = df.observe(seen, *[value.alias(name) for name, value in counts.items()])
    if where is not None:
        df = df.filter(where)
    try:
        if row_id:
            # A range shuffle samples its input before it reads it. It samples files here, so that what made
            # the rows runs once.
            df.write.parquet(f"{staging}/rows")
            ordered(spark.read.schema(df.schema).parquet(f"{staging}/rows"), row_id, files).write.parquet(f"{staging}/ordered")
            delete(spark, f"{staging}/rows")
        else:
            df.write.parquet(f"{staging}/ordered")
        if check:
            check(spark.read.parquet(f"{staging}/ordered"))
        move(spark, f"{staging}/ordered", path)
    finally:
        delete(spark, staging)
    return seen.get if counts else {}


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Refuses to overwrite. Partitioned by run; inside a run, files are ordered by shard, so reading
    one shard prunes by file statistics instead of needing a folder per shard."""
    runs = ["dataset_name", "model_config_checksum"]
    (
        manifest.repartitionByRange(*runs, "dataset_shard", "row_id")
        .sortWithinPartitions(*runs, "dataset_shard", "row_id")
        .write.mode("errorifexists").partitionBy(*runs).parquet(path)
    )


STORE_KEYS = ("dataset", "model_hash", "layer")


def append_embeddings(vectors: DataFrame, path: str) -> None:
    """Add vectors to a store, one folder per dataset, model and layer.

    Rebalancing brings a folder's rows together and splits them again where they are many, so files
    have a sound size and a model with most of the rows still writes from many tasks. Files are made beside the
    store and moved into it when they are complete, so that writers at the same time do not share a folder of
    unfinished files, and readers never see one.
    """
    spark = vectors.sparkSession
    staging = f"{path.rstrip('/')}.incoming-{uuid.uuid4().hex}"
    try:
        _rebalanced(vectors).write.partitionBy(*STORE_KEYS).parquet(staging)
        _, root, fs = _fs(spark, staging)
        # The move is a rename per file, as many as the rebalanced write made.
        base, found = fs.makeQualified(root).toString(), fs.listFiles(root, True)
        while found.hasNext():
            name = found.next().getPath()
            if name.getName()[0] not in "_.":
                move(spark, name.toString(), f"{path.rstrip('/')}{name.toString()[len(base):]}")
    finally:
        delete(spark, staging)


def _rebalanced(vectors: DataFrame) -> DataFrame:
    return vectors.hint("rebalance", *STORE_KEYS).sortWithinPartitions(*STORE_KEYS, "row_id")


def replace_embeddings(vectors: DataFrame, path: str) -> None:
    """Rewrite only the (dataset, model, layer) folders present in the input."""
    (
        _rebalanced(vectors).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*STORE_KEYS).parquet(path)
    )


def append_status(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def save_model_configs(configs: DataFrame, path: str) -> DataFrame:
    """(dataset, model_hash, config): rows (dataset, config as canonical JSON) stored under their checksums, in one write."""
    rows = configs.select("dataset", checksum(F.col("config")).alias("model_hash"), "config")
    rows.write.mode("append").parquet(path)
    return rows


def save_model_config(spark: SparkSession, dataset: str, config: dict, path: str) -> str:
    """Store a model configuration under its checksum, which is returned."""
    checksum = config_checksum(config)
    row = [(dataset, checksum, canonical_json(config))]
    frame = spark.createDataFrame(row, "dataset string, model_hash string, config string")
    frame.coalesce(1).write.mode("append").parquet(path)
    return checksum


def save_json(spark: SparkSession, path: str, content: dict) -> None:
    write_text(spark, path, json.dumps(content, indent=2, sort_keys=True))


def metrics_long(metrics: DataFrame, *keys: str) -> DataFrame:
    """Metric columns as (metric, value) rows."""
    values = [c for c in metrics.columns if c not in keys]
    return metrics.unpivot(list(keys), values, "metric", "value").withColumn("value", F.col("value").cast("double"))

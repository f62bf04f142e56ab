"""Readers with explicit schemas and predicates that reach the scan."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe import schemas
from gridprobe.functions import dims, hashing, naming
from gridprobe.operators import registry
from gridprobe.sources import sinks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder, one Parquet file or folder each."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    schema = table(spark, folder, name).schema
    source = spark.readStream.schema(schema)
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if sinks.is_folder(spark, path):
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def instruments_csv(spark: SparkSession, path: str) -> DataFrame:
    """An instrument table with a header and the columns category, program, name."""
    return spark.read.schema(dims.INSTRUMENT_SCHEMA).csv(path, header=True, escape='"')


def dataset_table(spark: SparkSession, name: str, path: str, form: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schemas.DATASETS[name])
    return reader.csv(path, header=True) if form == "csv" else reader.parquet(path)


def manifest(spark: SparkSession, path: str, dataset: str, model_hash: str, shard: int | None = None) -> DataFrame:
    """The manifest of one run, or of one of its shards."""
    rows = spark.read.parquet(path).filter(
        (F.col("dataset_name") == dataset) & (F.col("model_config_checksum") == model_hash)
    )
    return rows if shard is None else rows.filter(F.col("dataset_shard") == shard)


def model_config(spark: SparkSession, path: str, dataset: str, model_hash: str) -> dict:
    """The configuration stored under a checksum; an unknown one is an error."""
    found = (
        spark.read.schema(schemas.MODEL_CONFIG).parquet(path)
        .filter((F.col("dataset") == dataset) & (F.col("model_hash") == model_hash))
        .select("config").first()
    )
    if found is None:
        raise ValueError(f"no configuration {model_hash} for {dataset}")
    return json.loads(found["config"])


def model_configs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (dataset, model_hash) with the configurations stored under them, by one join; an unknown one is NULL."""
    stored = spark.read.schema(schemas.MODEL_CONFIG).parquet(path).dropDuplicates(["dataset", "model_hash"])
    return wanted.join(stored.select("dataset", "model_hash", "config"), ["dataset", "model_hash"], "left")


def embeddings(
    spark: SparkSession, path: str, dataset: str, model_hash: str, layer: int | None = None,
    row_ids: DataFrame | None = None,
) -> DataFrame:
    """Vectors of a run, optionally of one layer and of the given row ids.

    The run and the layer prune folders. Row ids come as a table, so any number of them works.
    """
    rows = spark.read.schema(schemas.EMBEDDING).parquet(path)
    rows = rows.filter((F.col("dataset") == dataset) & (F.col("model_hash") == model_hash))
    if layer is not None:
        rows = rows.filter(F.col("layer") == layer)
    return rows if row_ids is None else rows.join(row_ids.select("row_id"), "row_id", "left_semi")


def signals(df: DataFrame, channels: str, rate: Column | int, seconds: float) -> DataFrame:
    """Decoded channels as one mono signal: mixed down, cut to the first seconds, peak-normalised."""
    from gridprobe.functions import signal

    mono = signal.downmix(F.col(channels))
    wanted = F.floor((rate if isinstance(rate, Column) else F.lit(rate)) * seconds).cast("int")
    return df.withColumn("_mono", mono).withColumn(
        "samples", signal.peak_normalised(F.slice("_mono", F.lit(1), wanted))
    ).drop("_mono")


def exports(spark: SparkSession, folder: str, concept: str, configs: DataFrame, extension: str = "parquet") -> DataFrame:
    """Embedding exports of a concept folder, with the model each belongs to."""
    paths = sinks.list_paths(spark, f"{folder.rstrip('/')}/*.{extension}")
    return registry.list_exports(paths, configs, concept)


def file_checksums(spark: SparkSession, pattern: str, algorithm: str = "sha256", gunzip: bool = False) -> DataFrame:
    """(path, checksum) of the files that match a glob; each file is read whole by one task."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    if gunzip:

        def unpack(batches):
            import gzip

            for batch in batches:
                yield batch.assign(content=[gzip.decompress(c) for c in batch["content"]])

        files = files.mapInPandas(unpack, "path string, content binary")
    return files.select("path", hashing.checksum(F.col("content"), algorithm).alias("checksum"))


def audio_paths(df: DataFrame, offset: str = "offset_file_path", synth: str = "synth_file_path") -> DataFrame:
    return df.withColumn("audio_file_path", naming.audio_path(F.col(offset), F.col(synth)))

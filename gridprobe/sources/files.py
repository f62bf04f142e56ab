"""What tasks learn from files without holding them: shapes of stored arrays from their footers, digests chunk by chunk."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The digests a checksum may be made with.
ALGORITHMS = (
    "md5", "sha1", "sha224", "sha256", "sha384", "sha512",
    "sha3_224", "sha3_256", "sha3_384", "sha3_512", "blake2b", "blake2s",
)
CHUNK = 1 << 20


def listed(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, or of those that match a glob; nothing of them is read. Spark does
    not list files without content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    return reader.load(path).select("path", "length")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def digests(spark: SparkSession, path: str, algorithm: str = "sha256", gunzip: bool = False, names: str = "*",
            chunk: int = CHUNK) -> DataFrame:
    """(path, checksum) of files, as hexadecimal text; with ``gunzip`` of what they unpack to.

    A task reads a file in chunks, so files of any size fit. Files without content have no row. An unknown algorithm
    is an error.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown algorithm: {algorithm}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, where = located(name)
                digest = hashlib.new(algorithm)
                with system.open_input_stream(where, compression="gzip" if gunzip else None) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                yield pa.record_batch({"path": pa.array([name]), "checksum": pa.array([digest.hexdigest()])})

    return listed(spark, path, names).select("path").mapInArrow(work, "path string, checksum string")


def footers(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    """(path, length, n, n_values, kind) of the Parquet files below a folder, from their footers: rows, and values and
    physical type of an array column; these are NULL where a file lacks the column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                system, where = located(name)
                with system.open_input_file(where) as file:
                    found = pq.ParquetFile(file).metadata
                values, kind = None, None
                for g in range(found.num_row_groups):
                    for c in range(found.num_columns):
                        part = found.row_group(g).column(c)
                        if part.path_in_schema.split(".")[0] == column:
                            values, kind = (values or 0) + part.num_values, part.physical_type
                yield pa.record_batch({
                    "path": pa.array([name]), "length": pa.array([length]), "n": pa.array([found.num_rows]),
                    "n_values": pa.array([values], pa.int64()), "kind": pa.array([kind], pa.string()),
                })

    files = listed(spark, path, "*.parquet")
    return files.mapInArrow(work, "path string, length long, n long, n_values long, kind string")


def store_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, model_hash, n, n_layers, width, kind, bytes): the shape of every stored export, as its files have it.

    ``n`` and ``width`` are NULL where layers, or files, do not agree.
    """
    key = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)", 1).alias(name)
    files = footers(spark, path).filter("n > 0").select("*", key("dataset"), key("model_hash"), key("layer"))
    whole = (F.col("n_values") % F.col("n") == 0).cast("int")
    layers = files.groupBy("dataset", "model_hash", "layer").agg(
        F.sum("n").alias("n"), F.min(F.col("n_values") / F.col("n")).alias("least"), F.max(F.col("n_values") / F.col("n")).alias("most"),
        F.min(whole).alias("whole"), F.min("kind").alias("kind"), F.sum("length").alias("bytes"),
    )
    agree = (F.min("least") == F.max("most")) & (F.min("whole") == 1)
    return layers.groupBy("dataset", "model_hash").agg(
        F.when(F.min("n") == F.max("n"), F.min("n")).alias("n"), F.count(F.lit(1)).cast("int").alias("n_layers"),
        F.when(agree, F.min("least").cast("int")).alias("width"), F.min("kind").alias("kind"), F.sum("bytes").alias("bytes"),
    )

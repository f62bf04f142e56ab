"""Helpers the operators share: staged tables, hashing of ids, words, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.session import scratch_path

# A word is a run of characters outside these six; in UTF-8 bytes ``bytes.split()`` cuts at exactly them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts its lineage.

    The files outlive the executors that wrote them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        if (path := getattr(table, "_staged_path", None)) is not None:
            delete_path(table.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(folds)), F.lit(0)).cast("int")


def hash_share(id_column: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit("share"), id_column), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(labels: DataFrame, label: str, folds: int, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of training rows: those outside fold 0 of ``folds``, thinned by a hash of the id to
    ``bound`` rows in expectation, so that the table may be broadcast. Repeated ids keep the largest label;
    NULL ids and labels are no training rows. With ``bound`` rows or fewer nothing is left out."""
    rows = labels.select(F.col(id_col).alias("sample_id"), F.col(label).cast("int").alias("sample_label")).filter(
        F.col("sample_id").isNotNull() & F.col("sample_label").isNotNull() & (fold_of(F.col(id_col), folds) != 0)
    )
    n = rows.count()
    if n > bound:
        rows = rows.filter(hash_share(F.col("sample_id")) < bound / n)
    return F.broadcast(rows.groupBy("sample_id").agg(F.max("sample_label").alias("sample_label")))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The values of a string or binary Arrow column as bytes."""
    return column.cast(pa.binary()).to_pylist()


def blob_rows(df: DataFrame) -> np.ndarray | None:
    """The element-wise sum of binary columns ``part`` of float64, added up in two rounds of tasks so that
    the driver gets a bounded number of blobs whatever the number of partitions."""
    mergers = 16

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("part").to_pylist():
                part = np.frombuffer(value, dtype=np.float64)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

    merged = df.select("part").repartition(mergers).mapInArrow(add, "part binary")
    return sum_of_parts(merged)


def sum_of_parts(df: DataFrame) -> np.ndarray | None:
    """The same for a table that has few rows by construction."""
    parts = [np.frombuffer(bytes(row["part"]), dtype=np.float64) for row in df.collect()]
    return np.sum(parts, axis=0) if parts else None

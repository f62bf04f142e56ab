"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.llm import decontaminate, mixing, quality, simhash, spans
from gridprobe.llm.common import stage
from gridprobe.sources import tables


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    field = quality.fit(docs, tables.table(spark, sf_dir, "labels"))
    bundled = docs.select(F.struct("*").alias("row"), "text")
    return quality.scored(bundled, field).filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of every group of near-duplicates."""
    return simhash.representatives(docs)


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that an earlier occurrence has already; one left without text stays, empty."""
    cut = spans.cut_rows(docs).select("row.*", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, tables.table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each remaining document enters the mix of sources."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeated_spans),
    ("benchmark decontamination", without_benchmark_items),
    ("mixing sources to target weights", mixed_sources),
]

# The classifier is trained and fingerprints use a hash that DuckDB lacks, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.split()[0].lower())
    return docs

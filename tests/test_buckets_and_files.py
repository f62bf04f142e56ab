"""Bucketed tables, keyed permutations, footers and streamed digests."""

import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gridprobe.operators import permutation
from gridprobe.plans import probes
from gridprobe.sources import buckets, files, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stores")
    labels = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("label"))
    vectors = spark.range(1000).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("float"), F.lit(1.5)).cast("array<float>").alias("embedding"))
    for name, table in (("labels", labels), ("vectors", vectors)):
        buckets.publish(table, str(folder / name), 8)
    return folder


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_join_without_exchange(spark, stores):
    labels, vectors = (buckets.read(spark, str(stores / n)) for n in ("labels", "vectors"))
    both = buckets.joined(labels, vectors)
    assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
    rows = both.collect()
    assert len(rows) == 1000 and all(r["embedding"] == [r["row_id"], 1.5] and r["label"] == str(r["row_id"] % 7) for r in rows)
    assert buckets.read(spark, str(stores / "labels")).inputFiles() and len(list((stores / "labels/rows").glob("*.parquet"))) == 8


def test_assembled_rows_are_not_shuffled(spark, stores, no_broadcast):
    """Encoding and splitting look values up, so the label table keeps its buckets up to the join with the vectors."""
    labels, vectors = (buckets.read(spark, str(stores / n)) for n in ("labels", "vectors"))
    rows = probes.assemble(labels, vectors, "label", "multiclass")
    moved = [line for line in plan(rows).splitlines() if re.search(r"\bExchange hashpartitioning", line)]
    assert moved == []
    assert rows.count() == 1000 and {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "valid", "test"}


def test_batches_read_their_buckets_only(spark, stores):
    path = str(stores / "vectors")
    seen = []
    for step in range(4):
        ids = [r["row_id"] for r in buckets.random_batch(spark, path, 300, step, seed=5).collect()]
        assert len(ids) == len(set(ids)) == (300 if step < 3 else 100)
        seen += ids
    assert sorted(seen) == list(range(1000))
    again = [r["row_id"] for r in buckets.random_batch(spark, path, 300, 0, seed=5).collect()]
    other = [r["row_id"] for r in buckets.random_batch(spark, path, 300, 4, seed=5).collect()]
    assert sorted(again) == sorted(seen[:300]) != sorted(other) and len(other) == 300
    # The planner names the buckets only where it is told to keep them.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        few = buckets.random_batch(spark, path, 2, 7)
        assert few.count() == 2 and int(re.search(r"SelectedBucketsCount: (\d+) out of 8", plan(few)).group(1)) <= 2
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_publish_is_write_once(spark, stores, tmp_path):
    with pytest.raises(RuntimeError, match="exists already"):
        buckets.publish(spark.range(3).withColumnRenamed("id", "row_id"), str(stores / "labels"), 2)
    with pytest.raises(ValueError, match="is NULL"):
        buckets.publish(spark.sql("SELECT CAST(NULL AS LONG) AS row_id"), str(tmp_path / "n"), 2)
    assert list(tmp_path.iterdir()) == []
    buckets.publish(spark.range(0).withColumnRenamed("id", "row_id"), str(tmp_path / "e"), 2)
    assert buckets.read(spark, str(tmp_path / "e")).count() == buckets.random_batch(spark, str(tmp_path / "e"), 4, 0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 1023, 4097])
def test_permutation(spark, n):
    place = permutation.permuted(F.col("id"), n, 3)
    got = [r[0] for r in spark.range(n).select(place).collect()]
    assert sorted(got) == list(range(n)) and (n < 16 or got != list(range(n)))
    assert spark.range(n).select(permutation.permuted(F.col("id"), n, 3)).collect() == spark.range(n).select(place).collect()
    with pytest.raises(Exception, match="outside"):
        spark.range(n, n + 1).select(place).collect()


def test_batch_ranges():
    assert [permutation.batch_range(10, 4, s) for s in range(4)] == [(0, 0, 4), (0, 4, 8), (0, 8, 10), (1, 0, 4)]
    assert permutation.batch_range(3, 8, 2) == (2, 0, 3)


@pytest.mark.parametrize("algorithm", files.ALGORITHMS)
def test_digests(spark, tmp_path, algorithm):
    data = bytes(range(256)) * 20
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "z.gz").write_bytes(gzip.compress(data))
    got = {r["path"].rsplit("/", 1)[1]: r["checksum"] for r in files.digests(spark, str(tmp_path), algorithm, names="*.bin", chunk=1000).collect()}
    assert got == {"a.bin": hashlib.new(algorithm, data).hexdigest()}
    packed = files.digests(spark, str(tmp_path), algorithm, gunzip=True, names="*.gz", chunk=999).first()
    assert packed["checksum"] == hashlib.new(algorithm, data).hexdigest()


def test_unknown_digest(spark, tmp_path):
    with pytest.raises(ValueError, match="Unknown algorithm"):
        files.digests(spark, str(tmp_path), "crc32")


def test_shapes_that_do_not_agree(spark, tmp_path):
    path = str(tmp_path / "store")
    row = "SELECT '{}' AS dataset, 'h' AS model_hash, {} AS layer, {}L AS row_id, array{} AS embedding"
    for dataset, layer, i, vector in (("a", 0, 1, "(1.0f, 2.0f)"), ("a", 1, 1, "(1.0f, 2.0f)"), ("a", 0, 2, "(1.0f, 2.0f)"),
                                      ("b", 0, 1, "(1.0f, 2.0f)"), ("b", 0, 2, "(1.0f)")):
        sinks.append_embeddings(spark.sql(row.format(dataset, layer, i, vector)), path)
    got = {r["dataset"]: (r["n"], r["n_layers"], r["width"], r["kind"]) for r in files.store_shapes(spark, path).collect()}
    assert got == {"a": (None, 2, 2, "FLOAT"), "b": (2, 1, None, "FLOAT")}
    sinks.append_embeddings(spark.sql(row.format("a", 1, 2, "(3.0f, 4.0f)")), path)
    assert {r["dataset"]: r["n"] for r in files.store_shapes(spark, path).collect()}["a"] == 2

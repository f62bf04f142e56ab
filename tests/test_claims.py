"""Runs that overlap in time leave one row per sample; claims end with their runs and grow stale."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gridprobe.plans import claims
from gridprobe.plans import embedding_job as job


@pytest.fixture()
def case(spark):
    manifest = spark.range(40).select(F.col("id").alias("row_id"), F.floor(F.col("id") / 10).cast("int").alias("dataset_shard"))
    signals = spark.range(40).select(F.col("id").alias("row_id"), F.array(*[F.col("id").cast("float")] * 4).alias("samples"))
    return manifest, signals


def ran(case, folder, **more):
    def load():
        return lambda rows: [[float(r[0]), 1.0] for r in rows]

    return job.run_job(*case, f"{folder}/store", f"{folder}/status", more.pop("load", load), "d", "h", **more)


def stored(spark, folder):
    return sorted(r["row_id"] for r in spark.read.parquet(f"{folder}/store").collect())


def test_two_runs_at_once(spark, case, tmp_path):
    """Whatever either leaves to the other is there when both have ended, once."""
    gate = threading.Barrier(2)

    def one(_):
        gate.wait()
        return ran(case, tmp_path)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(one, range(2)))
    assert stored(spark, tmp_path) == list(range(40))
    assert ran(case, tmp_path) == 40 and stored(spark, tmp_path) == list(range(40))


def test_a_run_inside_another(spark, case, tmp_path):
    """A whole run begins and ends while another holds two of four shards."""
    place = f"{tmp_path}/store.claims/d/h/0"
    held, mine = claims.claim(spark.createDataFrame([(1,), (3,)], "shard int"), place, "other")
    assert sorted(r["shard"] for r in mine.collect()) == [1, 3]
    assert ran(case, tmp_path) == 20
    assert stored(spark, tmp_path) == [*range(0, 10), *range(20, 30)]
    held.close()
    assert ran(case, tmp_path) == 40 and stored(spark, tmp_path) == list(range(40))


def test_shards_side_by_side(spark, case, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda s: ran(case, tmp_path, only_shards=[s]), range(4)))
    assert stored(spark, tmp_path) == list(range(40))


def test_tickets(spark, tmp_path):
    shards = spark.createDataFrame([(0,), (1,)], "shard int")
    root = str(tmp_path / "c")
    first, mine = claims.claim(shards, root, "a")
    second, none = claims.claim(shards.union(spark.createDataFrame([(2,)], "shard int")), root, "b")
    assert (first.number, second.number) == (1, 2) and mine.count() == 2 and [r["shard"] for r in none.collect()] == [2]
    # A claim that is open for too long is lost, and its run must not write any more.
    late, all_of_them = claims.claim(shards, root, "c", stale_seconds=0)
    assert late.number == 3 and all_of_them.count() == 2
    with pytest.raises(RuntimeError, match="too long"):
        late.check()
    first.check()
    for held in (first, second, late):
        held.close()
    assert claims.claim(shards, root, "d")[1].count() == 2


def test_one_of_many_gets_a_number(spark, tmp_path):
    shards = spark.createDataFrame([(0,)], "shard int")
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: claims.claim(shards, str(tmp_path / "c"), f"r{k}"), range(6)))
    assert sorted(held.number for held, _ in got) == [1, 2, 3, 4, 5, 6]
    assert sum(mine.count() for _, mine in got) == 1


def test_a_failed_run_frees_its_shards(spark, case, tmp_path):
    def broken():
        raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        ran(case, tmp_path, load=broken)
    assert ran(case, tmp_path) == 40


def test_nothing_to_do(spark, case, tmp_path):
    held, _ = claims.claim(spark.range(4).selectExpr("CAST(id AS INT) AS shard"), f"{tmp_path}/store.claims/d/h/0", "other")
    assert ran(case, tmp_path) == 0
    held.close()

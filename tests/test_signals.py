"""Sample arrays and pooling against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridprobe.functions import hashing, signal
from gridprobe.operators import guards, pooling
from gridprobe.sources import tables


def frame(spark, *arrays):
    return spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(arrays)], "row_id bigint, v array<float>")


def test_silence(spark):
    df = frame(spark, [0, 0], [0, 1e-30], [])
    flags = df.select("row_id", signal.is_silent(F.col("v")).alias("is_silent"))
    assert {r["row_id"]: r["is_silent"] for r in flags.collect()} == {0: True, 1: False, 2: True}
    assert tuple(guards.silent_count(flags).first()) == (3, 2)


def test_peak_normalisation(spark):
    got = {r[0]: r[1] for r in frame(spark, [1, -4, 2], [0, 0]).select("row_id", signal.peak_normalised(F.col("v"))).collect()}
    assert got == {0: [0.25, -1.0, 0.5], 1: [0.0, 0.0]}


def test_loaded_signal_is_mono_cut_and_normalised(spark):
    df = spark.createDataFrame([(0, [[1.0, 3.0, 9.0], [3.0, 5.0, 9.0]])], "row_id bigint, channels array<array<float>>")
    assert tables.signals(df, "channels", 2, 1.0).first()["samples"] == [0.5, 1.0]


def test_trim_and_crop_limits(spark):
    df = frame(spark, [1, 2, 3, 4])
    row = df.select(signal.head_trim(F.col("v"), 4).alias("t")).first()["t"]
    assert (row["kept"], row["removed"]) == ([1, 2, 3, 4], 0)
    with pytest.raises(Exception, match="cannot trim to 5: only 4 samples"):
        df.select(signal.head_trim(F.col("v"), 5)).collect()
    with pytest.raises(Exception, match="cannot crop to 4: only 4 samples"):
        df.select(signal.random_crop(F.col("v"), 4, F.lit(0.5))).collect()


def test_crops_differ_and_repeat(spark):
    df = frame(spark, range(1000)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19))))
    crop = signal.random_crop(F.col("v"), 10, hashing.hash_unit(1, F.col("row_id"), F.col("k")))
    starts = [r["c"]["start"] for r in df.select("k", crop.alias("c")).orderBy("k").collect()]
    assert len(set(starts)) > 15 and all(0 <= s < 990 for s in starts)
    assert starts == [r["c"]["start"] for r in df.select("k", crop.alias("c")).orderBy("k").collect()]


def test_minimum_duration(spark):
    df = frame(spark, range(8), range(7))
    assert [r["row_id"] for r in guards.too_short(df, F.size("v"), 2, 4.0).collect()] == [1]
    good, bad = guards.split_rejects(df, signal.long_enough(F.col("v"), 2, 4.0))
    assert (good.count(), bad.count()) == (1, 1)


@pytest.mark.parametrize("features, frames, width", [(128, 9, 768), (12, 5, 72), (20, 4, 120)])
def test_moments(spark, features, frames, width):
    matrix = np.random.default_rng(0).normal(size=(features, frames))
    df = spark.createDataFrame([(0, matrix.ravel().tolist())], "row_id bigint, v array<double>")
    got = pooling.moment_vectors(df, "v", (features, frames), "m").first()["m"]
    stages = [np.diff(matrix, n=k, axis=1) for k in range(3)]
    want = np.concatenate([p for s in stages for p in (s.mean(axis=1), s.std(axis=1))])
    assert len(got) == width
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_layer_pooling(spark):
    states = np.random.default_rng(1).normal(size=(3, 5, 4))
    df = spark.createDataFrame([(0, states.tolist())], "row_id bigint, s array<array<array<double>>>")
    pooled = {r["layer"]: r["embedding"] for r in pooling.pool_layers(df, "s", "row_id").collect()}
    np.testing.assert_allclose([pooled[i] for i in range(3)], states.mean(axis=1))
    one = pooling.pool_layers(df, "s", "row_id", layer=2).first()
    assert one["layer"] == 2
    np.testing.assert_allclose(one["embedding"], states[2].mean(axis=0))
    both = df.select(signal.mean_over_two_axes(F.col("s")).alias("m")).first()["m"]
    np.testing.assert_allclose(both, states.mean(axis=(1, 2)))


def test_concatenation_keeps_the_order(spark):
    a, b = frame(spark, [1], [2]), frame(spark, [3], [4])
    got = pooling.concat_features([b, a], "row_id", "v", "all").orderBy("row_id").collect()
    assert [r["all"] for r in got] == [[3, 1], [4, 2]]


def test_store_checks(spark):
    df = frame(spark, [0, 0], [1, 0], [1])
    assert tuple(guards.blank_counts(df, "v").first()) == (3, 1)
    assert tuple(guards.dimension_range(df, "v").first()) == (1, 2, False)
    assert guards.check_row_counts(df, df) == 3
    with pytest.raises(RuntimeError, match="3 rows but the store has 1"):
        guards.check_row_counts(df, df.limit(1))

"""Exact ranks, splits and label codes, also when one key holds most of the rows."""

import pytest
from pyspark.sql import functions as F

from gridprobe.functions import hashing
from gridprobe.operators import grid, labels, ranks, scaling, splits


def skewed(spark, n=20_000):
    """A third of the rows share one label, and a few lie far out."""
    label = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 997 == 0, F.col("id") * 1e6).otherwise(
        F.sqrt(F.col("id").cast("double"))
    )
    return spark.range(n).select(F.col("id").alias("row_id"), label.alias("label"))


@pytest.mark.parametrize("direct", [10, 500, 1_000_000])
def test_keys_at_ranks(spark, monkeypatch, direct):
    monkeypatch.setattr(ranks, "DIRECT_ROWS", direct)
    df = skewed(spark)
    order = sorted((r["label"], r["row_id"]) for r in df.collect())
    wanted = [0, 1, 83, 5_000, 6_700, 19_998, 19_999, 20_000]
    n, found = ranks.keys_at_ranks(df, "label", "row_id", wanted)
    assert n == len(order)
    assert found == {r: order[r] for r in wanted if r < n}


@pytest.mark.parametrize("bounds", [None, (0, 2**62)])
def test_keys_at_ranks_of_large_integers(spark, monkeypatch, bounds):
    """Keys that a double cannot tell apart, each on many rows, and large ties."""
    monkeypatch.setattr(ranks, "DIRECT_ROWS", 20)
    df = spark.range(3000).select(
        (F.lit(2**61) + F.col("id") % 3).alias("k"), (F.lit(2**60) + F.col("id") * 7).alias("t"), F.lit("x").alias("wide")
    )
    order = sorted((2**61 + i % 3, 2**60 + i * 7) for i in range(3000))
    n, found = ranks.keys_at_ranks(df, "k", "t", [0, 999, 1000, 1700, 2999], bounds)
    assert n == 3000 and found == {r: order[r] for r in (0, 999, 1000, 1700, 2999)}


def test_keys_at_ranks_of_an_empty_table(spark):
    assert ranks.keys_at_ranks(skewed(spark).limit(0), "label", "row_id", [0, 5]) == (0, {})


def test_dense_index(spark):
    df = ranks.with_dense_index(skewed(spark), "label", "row_id", name="i")
    rows = sorted((r["label"], r["row_id"], r["i"]) for r in df.collect())
    assert [r[2] for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("n, sizes", [(48, (33, 7, 8)), (120, (84, 18, 18)), (288, (201, 43, 44)), (336, (235, 50, 51))])
def test_shuffle_split_sizes(spark, n, sizes):
    df = splits.shuffle_split(spark.range(n).withColumnRenamed("id", "row_id"), seed=3)
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert (counts["train"], counts["valid"], counts["test"]) == sizes
    assert splits.shuffle_split_sizes(n) == sizes


def test_shuffle_split_depends_only_on_seed_and_id(spark):
    ids = spark.range(1000).withColumnRenamed("id", "row_id")
    again = splits.shuffle_split(ids.repartition(7), seed=3)
    first = splits.shuffle_split(ids, seed=3)
    assert first.exceptAll(again).isEmpty()
    assert not first.exceptAll(splits.shuffle_split(ids, seed=4)).isEmpty()


def test_split_of_a_table_beyond_the_direct_limit(spark, monkeypatch):
    ids = spark.range(5000).withColumnRenamed("id", "row_id")
    small = splits.shuffle_split(ids, seed=3)
    monkeypatch.setattr(ranks, "DIRECT_ROWS", 50)
    assert small.exceptAll(splits.shuffle_split(ids, seed=3)).isEmpty()


def test_extrapolation_split(spark):
    df = spark.range(80).select(F.col("id").alias("row_id"), (F.floor(F.col("id") / 4) + 80).alias("bpm"))
    rows = splits.extrapolation_split(df, "bpm", seed=1).collect()
    by = {s: sorted(r["row_id"] for r in rows if r["split"] == s) for s in ("train", "test", "valid")}
    assert by["train"] == list(range(12, 68))
    assert (len(by["test"]), len(by["valid"])) == (12, 12)


def test_rows_without_a_label_are_in_no_split(spark):
    df = spark.range(20).select(F.col("id").alias("row_id"), F.when(F.col("id") >= 10, F.col("id")).alias("y"))
    rows = splits.extrapolation_split(df, "y").collect()
    assert {r["row_id"] for r in rows if r["split"] is None} == set(range(10))
    assert sum(r["split"] == "train" for r in rows) == 7


@pytest.mark.parametrize("size, expected", [(64, 64), (500, 100)])
def test_random_batch(spark, size, expected):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    batch = splits.random_batch(df, size, seed=1, step=2)
    assert batch.distinct().count() == expected


def test_positional_slice(spark):
    df = skewed(spark, 1000)
    order = sorted((r["label"], r["row_id"]) for r in df.collect())
    got = splits.positional_slice(df, "label", "row_id", 100, 120)
    assert sorted((r["label"], r["row_id"]) for r in got.collect()) == order[100:120]
    assert splits.positional_slice(df, "label", "row_id", 2000, 2100).count() == 0


@pytest.mark.parametrize("limit", [3, 100])
def test_codes_are_dense_and_ordered(spark, limit):
    values = ["b", "a", "c", "a", "b", "d", "a"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    coded = {r["v"]: r["v_encoded"] for r in labels.encode(df, "v", limit=limit).collect()}
    assert coded == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_signature_text_sorts_as_text(spark):
    signatures = ["(2, 2)", "(2, 4)", "(3, 4)", "(3, 8)", "(4, 4)", "(6, 8)", "(9, 8)", "(12, 8)"]
    df = spark.createDataFrame([(v,) for v in signatures], "v string")
    coded = {r["v"]: r["v_encoded"] for r in labels.encode(df, "v").collect()}
    assert coded == {v: i for i, v in enumerate(sorted(signatures))}
    assert coded["(12, 8)"] == 0


def test_one_hot(spark):
    df = labels.one_hot(spark.createDataFrame([("x",), ("y",), ("x",)], "v string"), "v")
    assert {(r["v"], tuple(r["v_ohe"])) for r in df.collect()} == {("x", (1.0, 0.0)), ("y", (0.0, 1.0))}
    coded = labels.encode(df.drop("v_ohe"), "v", "code")
    assert labels.one_hot(coded, "v", "code").first()["v_ohe"] in ([1.0, 0.0], [0.0, 1.0])


def test_infinite_and_missing_keys_have_ranks(spark, monkeypatch):
    """The same cut points whether stretches are sorted at once or searched by histogram."""
    inf, nan = float("inf"), float("nan")
    values = [inf, -inf, nan, 1e308, -1e308, 5e-324, 0.0, -0.0, None] * 60 + [float(i) ** 7 for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, v double")
    wanted = lambda n: list(range(0, n, 37))
    direct = ranks.keys_at_ranks(df, "v", "row_id", wanted)
    monkeypatch.setattr(ranks, "DIRECT_ROWS", 20)
    searched = ranks.keys_at_ranks(df, "v", "row_id", wanted)
    order = sorted((v != v, v, i) if v == v else (True, 0.0, i) for i, v in enumerate(values) if v is not None)
    assert direct[0] == searched[0] == len(order)
    for rank in wanted(len(order)):
        assert direct[1][rank][0] == searched[1][rank][0] or direct[1][rank][0] != direct[1][rank][0]
        assert direct[1][rank][0] == order[rank][1] or order[rank][0]
        assert direct[1][rank][1] == searched[1][rank][1] == order[rank][2]


def test_label_formats(spark):
    df = spark.createDataFrame([(50,), (130,), (210,)], "bpm int")
    assert [r["bpm"] for r in labels.format_labels(df, "bpm", "regression").orderBy("bpm").collect()] == [0.0, 0.5, 1.0]
    assert labels.format_labels(df, "bpm", "multiclass").columns == ["bpm", "bpm_encoded", "bpm_ohe"]
    with pytest.raises(ValueError, match="Unsupported output type"):
        labels.format_labels(df, "bpm", "ranking")


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 4.0])], "x int, v array<double>")
    assert {r["y"] for r in scaling.min_max(df, "x", "y").collect()} == {0.0}
    z = sorted(tuple(r["z"]) for r in scaling.standardise(df, "v", "z").collect())
    assert z == [(0.0, -1.0), (0.0, 1.0)]


def test_statistics_merge_across_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v"))
    for row in scaling.dimension_stats(df, "v", "g").collect():
        xs = [float(i) for i in range(1000) if i % 3 == row["g"]]
        mean = sum(xs) / len(xs)
        sigma = (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5
        assert row["n"] == len(xs)
        assert row["means"] == pytest.approx([mean, 2.0])
        assert row["deviations"] == pytest.approx([sigma, 0.0])


@pytest.mark.parametrize("short", [1, 10_000])
def test_dense_grid_with_short_and_long_dimensions(spark, monkeypatch, short):
    monkeypatch.setattr(grid, "SHORT_DIMENSION", short)
    a = spark.createDataFrame([("x",), ("y",)], "a string")
    b = spark.createDataFrame([(10,), (20,), (30,)], "b int")
    rows = grid.dense_grid(spark, [(a, ["a"]), (b, ["b"])]).orderBy("row_id").collect()
    assert [(r["row_id"], r["a"], r["b"]) for r in rows] == [
        (0, "x", 10), (1, "x", 20), (2, "x", 30), (3, "y", 10), (4, "y", 20), (5, "y", 30)
    ]


def test_checksums(spark):
    df = spark.createDataFrame([("abc123",), ("hello world",)], "t string")
    got = [r["c"] for r in df.select(hashing.checksum(F.col("t")).alias("c")).collect()]
    assert got == [
        "6ca13d52ca70c883e0f0bb101e425a89e8624de51db2d2392593af6a84118090",
        "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9",
    ]
    config = {"model_type": "JUKEBOX", "model_size": "L", "model_layer": 38, "concept": "tempos"}
    assert hashing.config_checksum(config) == "dfe502a2ea415da8dfe7d17ae641cb7f314283941d41747445e2a64507726372"
    for bad in ("shake_128", "crc"):
        with pytest.raises(ValueError, match="Unknown algorithm"):
            hashing.checksum(F.col("t"), bad)
        with pytest.raises(ValueError, match="Unknown algorithm"):
            hashing.config_checksum(config, bad)

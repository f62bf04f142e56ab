"""Metrics, run scans, instrument runs and export matching against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridprobe.functions import dims, vectors
from gridprobe.operators import instruments, metrics, registry, runs, sweeps


def test_confusion_over_present_labels(spark):
    df = spark.createDataFrame([(1, 0)], "y int, p int")
    cells = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_micro_f1_equals_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (1, 1), (0, 2)], "y int, p int")
    f1 = metrics.micro_f1(df, "y", "p").first()
    assert (f1["tp"], f1["fp"], f1["fn"], f1["f1"]) == (3, 2, 2, 0.6)
    assert metrics.accuracy(df, "y", "p").first()["accuracy"] == 0.6


def test_argmax_takes_the_first_maximum_and_entropy_does_not_overflow(spark):
    row = spark.createDataFrame([([1.0, 5.0, 5.0], [1000.0, 0.0])], "a array<double>, b array<double>").select(
        vectors.argmax(F.col("a")).alias("i"), vectors.cross_entropy(F.col("b"), F.lit(0)).alias("hit"),
        vectors.cross_entropy(F.col("b"), F.lit(1)).alias("miss"),
    ).first()
    assert tuple(row) == (1, 0.0, 1000.0)


def test_regression_scores(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    row = metrics.regression(df, "y", "p").first()
    assert row["loss"] == pytest.approx(1.25 / 3) and row["r2"] == pytest.approx(1 - 1.25 / 2)
    flat = metrics.regression(df.withColumn("y", F.lit(4.0)), "y", "p").first()
    assert flat["r2"] is None


def test_nan_scores_fail(spark):
    with pytest.raises(Exception, match="NaN score"):
        metrics.reject_nan(spark.createDataFrame([(float("nan"),)], "s double"), "s").collect()


def stops(scores, patience):
    """(used, stop, best step, best score) by walking through one run."""
    best, best_step, bored = float("-inf"), None, 0
    for step, score in enumerate(scores):
        if bored >= patience:
            return step, step, best_step, best
        if score > best:
            best, best_step, bored = score, step, 0
        else:
            bored += 1
    return len(scores), None, best_step, best


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_early_stopping_with_one_hot_run(spark, chunk):
    rng = random.Random(5)
    logs = {0: [rng.choice([0.1, 0.2, 0.3, 0.4]) for _ in range(400)], 1: [0.5], 2: list(range(30)),
            3: [1.0] + [0.0] * 3, 4: [rng.random() for _ in range(60)]}
    rows = [(run, step, float(v)) for run, scores in logs.items() for step, v in enumerate(scores)]
    df = spark.createDataFrame(rows, "run int, step int, score double")
    for patience in (3, 9):
        got = {
            r["run"]: (r["n_used"], r["stop_step"], r["best_step"], r["best_score"])
            for r in runs.early_stopping(df, "run", "step", "score", patience, chunk_steps=chunk).collect()
        }
        assert got == {run: stops(scores, patience) for run, scores in logs.items()}


def test_early_stopping_on_a_loss(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, 1.0, 2.0, 2.0, 0.5])], "run int, step int, s double")
    row = runs.early_stopping(df, "run", "step", "s", 2, negate=True).first()
    assert (row["n_used"], row["stop_step"], row["best_step"], row["best_score"]) == (4, 4, 1, 1.0)


@pytest.mark.parametrize("chunk", [1, 5, 1000])
def test_first_of_each_stretch(spark, chunk):
    rng = random.Random(1)
    rows = [(i * 3, rng.choice("ab")) for i in range(200)]
    expected = [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][1] != r[1]]
    df = spark.createDataFrame(rows, "k int, c string")
    assert sorted(tuple(r) for r in runs.first_of_each_stretch(df, "k", "c", chunk).collect()) == expected


def test_instrument_filters(spark):
    df = dims.instruments(spark)
    assert instruments.select_instruments(df).count() == 128
    assert instruments.select_instruments(df, True, True, True).count() == 92
    firsts = instruments.select_instruments(df, take_only_first_category=True).orderBy("program").collect()
    assert [r["program"] for r in firsts] == list(range(0, 120, 8))
    firsts = instruments.select_instruments(df, True, True, True, True).orderBy("program").collect()
    assert [r["program"] for r in firsts] == [0, 10, 16, 24, 32, 40, 48, 56, 64, 72, 80, 88, 104]
    assert instruments.drop_excluded(df).count() == 116


def test_best_per_group(spark):
    nan = float("nan")
    rows = [("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("a", 4, nan), ("a", 5, None), ("b", 7, 0.1), ("c", 1, nan)]
    df = spark.createDataFrame(rows, "c string, layer int, m double")
    got = {r["c"]: (r["layer"], r["m"]) for r in metrics.best_per(df, "m", ["layer"], "c").collect()}
    assert got == {"a": (2, 0.9), "b": (7, 0.1)}


def test_export_matching_takes_the_last_deep_enough_path(spark):
    rng = random.Random(2)
    families = ["MUSICGEN_DECODER_LM", "MUSICGEN_DECODER", "JUKEBOX"]
    concepts = ["chords", "tempos"]
    exports = [(f"p{i:03d}", rng.choice("LMS"), rng.choice(families), rng.randint(1, 9), rng.choice(concepts)) for i in range(90)]
    configs = [(i, rng.choice("LMS"), rng.choice(families), rng.randint(0, 10), rng.choice(concepts)) for i in range(200)]
    key = lambda f: f.split("_LM")[0] if f.startswith("MUSICGEN_DECODER") else f
    expected = {}
    for i, size, family, layer, concept in configs:
        fits = [p for p, s, f, n, c in exports if (s, c) == (size, concept) and key(f) == key(family) and n > layer]
        expected[i] = max(fits, default=None)
    got = registry.match_exports(
        spark.createDataFrame(configs, "id int, model_size string, model_type string, model_layer int, concept string"),
        spark.createDataFrame(exports, "path string, model_size string, model_type string, n_layers int, concept string"),
    )
    assert {r["id"]: r["export_path"] for r in got.collect()} == expected


def test_sweep_sizes(spark):
    sizes = {"handcrafted": 6048, "encoder": 1512, "jukebox": 504, "musicgen": 1029}
    for name, size in sizes.items():
        grid = sweeps.sweep(spark, name)
        assert sweeps.sweep_size(name) == size
        assert grid.drop("config_id").distinct().count() == size
    row = sweeps.sweep(spark, "handcrafted").orderBy(F.desc("config_id")).first()
    assert (row["model_type"], row["concept"], row["hidden_layer_sizes"], row["l2_weight_decay"]) == (
        "HANDCRAFT", "tempos", [512], 1e-3
    )

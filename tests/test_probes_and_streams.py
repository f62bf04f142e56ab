"""Fits in bands, saved probes, sweeps, and streams that end like their batch counterparts."""

import pytest
from pyspark.sql import functions as F

from gridprobe.operators import metrics, registry, sweeps
from gridprobe.plans import embedding_job as job
from gridprobe.plans import probes
from gridprobe.sources import configs, sinks, tables
from gridprobe.sources.configs import ProbeConfig
from gridprobe.streaming import incremental_extract, online_stats


def config(outputs, **hyper):
    return ProbeConfig(dataset="d", dataset_embeddings_label_column_name="label", model_hash="m", num_outputs=outputs, **hyper)


@pytest.fixture(scope="module")
def classes(spark):
    """Three separable classes in four dimensions, one of them constant."""
    noise = lambda k: (F.hash(F.col("id"), F.lit(k)) % 1000) / 2000.0
    label = F.col("id") % 3
    vector = F.array(label + noise(1), (label == 1).cast("double") + noise(2), noise(3), F.lit(1.0))
    df = spark.range(600).select(
        F.col("id").alias("row_id"), F.element_at(F.array(F.lit("c"), F.lit("a"), F.lit("b")), (label + 1).cast("int")).alias("label"),
        vector.cast("array<float>").alias("embedding"),
    )
    return probes.assemble(df, df, "label", "multiclass", seed=1).cache()


@pytest.fixture(scope="module")
def values(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") + 50).alias("bpm"),
        F.array(F.col("id") * 0.5 + 3, F.hash("id") % 100 / 100.0).cast("array<float>").alias("embedding"),
    )
    return probes.assemble(df, df, "bpm", "regression", seed=1)


def accuracy(probe, rows):
    return {r["split"]: r["accuracy"] for r in probes.evaluate(probe, rows, "split").collect()}


def train(rows):
    return rows.filter("split = 'train'")


@pytest.mark.parametrize("hyper", [{}, {"data_standardization": False, "l2_weight_decay": 1e-4}, {"hidden_layer_sizes": [16]}])
def test_classifier_learns(classes, hyper):
    scores = accuracy(probes.fit(train(classes), config(3, **hyper), "multiclass", 60), classes)
    assert scores["train"] > 0.95 and scores["valid"] > 0.9 and scores["test"] > 0.9


def test_regression_extrapolates(values):
    probe = probes.fit(train(values), config(1), "regression", 60)
    scores = {r["split"]: (r["n"], r["r2"]) for r in probes.evaluate(probe, values, "split").collect()}
    assert {s: n for s, (n, _) in scores.items()} == {"train": 280, "test": 60, "valid": 60}
    assert scores["valid"][1] > 0.99


def test_unknown_output_type(classes):
    with pytest.raises(ValueError, match="Unsupported output type"):
        probes.assemble(classes, classes, "y", "ranking")


def test_save_load_delete(spark, classes, tmp_path):
    root = str(tmp_path)
    probe = probes.fit(train(classes), config(3), "multiclass", 20)
    uid = probes.save(spark, probe, root, {"accuracy": 1.0})
    again = probes.load(spark, uid[:8], root)
    assert again.config == probe.config and again.means == probe.means
    assert accuracy(again, classes) == accuracy(probe, classes)
    probes.delete(spark, probe.config, root)
    assert sorted(p.name for p in (tmp_path / "d" / uid).glob("*.json")) == ["cfg.json", "metrics.json"]
    probes.delete(spark, probe.config, root, delete_metrics_and_config=True)
    with pytest.raises(ValueError, match="no saved probe"):
        probes.load(spark, uid, root)


def test_confusion_counts_every_row(classes):
    probe = probes.fit(train(classes), config(3), "multiclass", 20)
    cells = probes.confusion(probe, classes).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 600


def test_sweep_skips_missing_exports_and_ranks_layers(spark, classes):
    rows = sweeps.sweep(spark, "musicgen").filter("concept = 'chords' and model_layer in (0, 30)")
    exports = spark.createDataFrame(
        [("a", "chords", "S", "MUSICGEN_DECODER_LM", 25), ("b", "chords", "L", "MUSICGEN_DECODER", 49), ("z", "tempos", "L", "MUSICGEN_DECODER", 49)],
        "path string, concept string, model_size string, model_type string, n_layers int",
    )
    matched = registry.match_exports(rows, exports)
    made = probes.sweep_configs(matched, lambda r: configs.probe_config(
        r["concept"], r["model_type"], r["model_size"], r["model_layer"], hidden_layer_sizes=[]))
    assert sorted(c["model_hash"] for c in made) == [
        "MUSICGEN_DECODER-L-0", "MUSICGEN_DECODER-L-30", "MUSICGEN_DECODER-S-0"
    ]
    done = probes.sweep(classes, made, "multiclass", iterations=5)
    assert done.select("uid").distinct().count() == 3
    layered = done.withColumn("layer", F.rank().over(__import__("pyspark").sql.Window.orderBy("uid")))
    best = probes.best_layers(layered)
    assert best.count() == 1


def test_vectors_and_labels_do_not_pass_through_the_driver(spark):
    df = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"), F.array(F.col("id").cast("float")).alias("embedding"))
    joined = probes.assemble(df, df, "label", "multiclass")
    # What is broadcast is the list of classes.
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and joined.count() == 30


def test_passes_of_a_fit_have_no_more_tasks_than_cores(spark, classes):
    """A hundred passes over many small partitions sent the driver a report per partition and pass."""
    context, scattered = spark.sparkContext, classes.repartition(64, "row_id")
    expected = {r["split"]: float(r["count"]) for r in classes.groupBy("split").count().collect()}
    context.setJobGroup("packed", "fits of a sweep")
    try:
        done = probes.sweep(scattered, [config(3), config(3, l2_weight_decay=1e-3)], "multiclass", iterations=8).collect()
        probes.fit(train(scattered), config(3, hidden_layer_sizes=[4]), "multiclass", 8)
    finally:
        context.setJobGroup("", "")
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("packed") for s in tracker.getJobInfo(j).stageIds}
    tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info and info.numCompletedTasks]
    assert len(tasks) > 20 and sum(n >= 64 for n in tasks) <= 4, sorted(tasks)
    assert [r["value"] for r in done if r["metric"] == "n" and r["split"] == "train"] == [expected["train"]] * 2


def test_whole_sweep(spark, tmp_path):
    """Two layers of one model: the second layer holds the labels, the first is noise."""
    from gridprobe.plans.sweep import run_sweep

    table = spark.range(120).select(
        F.col("id").alias("row_id"), (F.col("id") % 4).cast("string").alias("chord_type"),
        F.hash("id").cast("double").alias("noise"), (F.col("id") % 4).cast("double").alias("signal"),
    )

    def load(concept, path, layer):
        assert (concept, path) == ("chords", "b")
        held = F.col("signal") if layer else F.col("noise") / 1e9
        vectors = table.select("row_id", F.array(held, held * held).cast("array<float>").alias("embedding"))
        return probes.assemble(table, vectors, "chord_type", "multiclass")

    rows = sweeps.expand_space(spark.range(8).withColumnRenamed("id", "config_id"), {
        "model_type": ("JUKEBOX",), "model_size": ("L",), "model_layer": (0, 1), "concept": ("chords", "notes"),
        "hidden_layer_sizes": ((),), "l2_weight_decay": (None, 1e-4),
    }).filter("concept = 'chords'")
    exports = spark.createDataFrame(
        [("a", "chords", "L", "JUKEBOX", 1), ("b", "chords", "L", "JUKEBOX", 72), ("c", "notes", "L", "JUKEBOX", 72)],
        "path string, concept string, model_size string, model_type string, n_layers int",
    )
    done = run_sweep(spark, rows, exports, load, str(tmp_path / "metrics"), iterations=40)
    assert done.select("layer", "uid").distinct().count() == 4
    n = done.count()
    assert run_sweep(spark, rows, exports, None, str(tmp_path / "metrics")).count() == n  # nothing is fitted again
    best = probes.best_layers(done, "concept", "model_type").first()
    assert best["layer"] == 1 and best["value"] > 0.9


def test_early_stopping_keeps_the_best_round(classes):
    cfg = config(3, early_stopping_eval_frequency=2, early_stopping_boredom=3)
    probe, log = probes.fit_with_early_stopping(train(classes), classes.filter("split = 'valid'"), cfg, max_rounds=40)
    assert log[-1]["boredom"] == 3 and len(log) < 40
    best = max(r["score"] for r in log)
    assert accuracy(probe, classes)["valid"] == pytest.approx(best) and best > 0.9


def parts(spark, tmp_path, df, pieces=3):
    folder = str(tmp_path / "in")
    for i in range(pieces):
        df.filter(F.col("row_id") % pieces == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_online_statistics_equal_batch(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.array(F.col("id") + 1e6, F.sqrt("id")).alias("v"))
    stats = online_stats.dimension_stats(parts(spark, tmp_path, df), "v")
    online_stats.keep_latest(stats, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["dim"]: (r["n"], r["mean"], r["deviation"]) for r in online_stats.read_latest(spark, str(tmp_path / "out")).collect()}
    want = {r["dim"]: (r["n"], r["mean"], r["deviation"]) for r in online_stats.dimension_stats(df, "v").collect()}
    assert got.keys() == want.keys()
    for dim in want:
        assert got[dim] == pytest.approx(want[dim], rel=1e-12)


def test_streamed_extraction_is_exactly_once(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("row_id"), F.array(*[(F.col("id") * i).cast("float") for i in (1, 2, 4, 8)]).alias("samples"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    load = job.moment_extractor(1)
    for run, upto in enumerate((20, 30)):
        # The second delivery repeats rows of the first.
        df.filter((F.col("row_id") < upto) & (F.col("row_id") >= 10 * run)).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        incremental_extract.extract_stream(stream, load, out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("row_id").distinct().count() == 30


def test_stream_state_is_bounded_and_old_samples_stay_single(spark, tmp_path):
    """Ten deliveries, then all again to the same stream, then all to a stream that has lost its checkpoint."""
    df = spark.range(200).select(F.col("id").alias("row_id"), F.array(*[(F.col("id") * i).cast("float") for i in (1, 2, 4, 8)]).alias("samples"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    load = job.moment_extractor(1)

    def run(checkpoint):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = incremental_extract.extract_stream(stream, load, out, str(tmp_path / checkpoint), remembered="0 seconds")
        query.awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == rows.select("row_id").distinct().count() == 200
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    for i in range(10):
        df.filter(F.col("row_id") % 10 == i).coalesce(1).write.mode("append").parquet(folder)
    assert max(run("a")) <= 40  # two deliveries of the ten
    df.coalesce(1).write.mode("append").parquet(folder)
    run("a")
    run("b")
    assert spark.read.parquet(out).select("stream").distinct().count() == 1


def test_replayed_batch_gives_the_same_rows(spark, tmp_path):
    """A failure after a batch was written and before it was committed."""
    df = spark.range(20).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("samples"))
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    df.write.parquet(folder)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(folder)
        incremental_extract.extract_stream(stream, job.moment_extractor(1), out, checkpoint).awaitTermination()
        for commit in (tmp_path / "cp" / "commits").iterdir():
            commit.unlink()
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("row_id").distinct().count() == 20


def test_rows_without_an_id_are_left_out(spark, tmp_path):
    df = spark.createDataFrame([(None, [1.0]), (1, [2.0]), (1, [2.0])], "row_id bigint, samples array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    incremental_extract.extract_stream(stream, job.moment_extractor(1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["row_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_metrics_sink(spark, tmp_path):
    wide = spark.createDataFrame([("u", "valid", 5, 0.5)], "uid string, split string, n bigint, accuracy double")
    sinks.append_metrics(sinks.metrics_long(wide, "uid", "split"), str(tmp_path / "m"))
    got = {(r["metric"], r["value"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got == {("n", 5.0), ("accuracy", 0.5)}


def test_table_stream_reads_file_and_folder(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    df.write.parquet(str(tmp_path / "t.parquet"))
    stream = tables.table_stream(spark, str(tmp_path), "t")
    stats = online_stats.value_stats(stream, "row_id")
    online_stats.keep_latest(stats, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert online_stats.read_latest(spark, str(tmp_path / "out")).first()["n"] == 5
    assert metrics.accuracy(df.withColumn("p", F.col("row_id")), "row_id", "p").first()["accuracy"] == 1.0

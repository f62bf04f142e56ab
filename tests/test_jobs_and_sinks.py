"""Writers, manifests, resumable jobs, status logs, configurations and exports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridprobe import schemas
from gridprobe.functions import dims
from gridprobe.operators import grid, guards, shards
from gridprobe.plans import datasets as ds
from gridprobe.plans import embedding_job as job
from gridprobe.plans import publishing
from gridprobe.sources import configs, sinks, tables


def test_publish_writes_once_and_in_order(spark, tmp_path):
    df = spark.range(1000).select((999 - F.col("id")).alias("row_id"), F.lit("x").alias("v"))
    path = str(tmp_path / "table")
    sinks.publish(df, path)
    assert spark.read.parquet(path).count() == 1000
    ranges = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.min("row_id").alias("lo"), F.max("row_id").alias("hi")
    ).orderBy("lo").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))
    with pytest.raises(RuntimeError, match="exists already"):
        sinks.publish(df, path)


def test_failed_publish_leaves_nothing(spark, tmp_path):
    df = spark.range(10).select(
        F.col("id").alias("row_id"), F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).cast("string").alias("v")
    )
    with pytest.raises(Exception, match="boom"):
        sinks.publish(df, str(tmp_path / "table"))
    assert list(tmp_path.iterdir()) == []


def test_dataset_tables_read_back(spark, tmp_path):
    df = ds.chords(grid.grid_ids(spark, [48, 3, 1]), instruments=dims.instrument_rows()[:1])
    sinks.publish(df, str(tmp_path / "chords"))
    back = tables.dataset_table(spark, "chords", str(tmp_path / "chords"))
    assert back.columns == schemas.columns("chords") and back.exceptAll(df).isEmpty()
    df.coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    text = tables.dataset_table(spark, "chords", str(tmp_path / "csv"), "csv")
    assert {r["inversion"] for r in text.collect()} == {"5", "6", "64"}


def test_instruments_csv(spark, tmp_path):
    path = tmp_path / "instruments.csv"
    path.write_text('Category,Number,Instrument\nPiano Timbres,0,Acoustic Grand Piano\nEnsemble Timbres,52,"Choir ""Aah"""\n')
    rows = tables.instruments_csv(spark, str(path)).orderBy("program").collect()
    assert [tuple(r) for r in rows] == [("Piano Timbres", 0, "Acoustic Grand Piano"), ("Ensemble Timbres", 52, 'Choir "Aah"')]


@pytest.mark.parametrize("n, sizes", [(1200, [300] * 4), (1201, [300] * 4 + [1]), (0, [])])
def test_shard_sizes(spark, n, sizes):
    assert shards.shard_sizes(n) == sizes
    assert shards.total_shards(n) == len(sizes)
    counted = shards.shard_counts(spark.range(n), "id").orderBy("shard").collect()
    assert [r["n"] for r in counted] == sizes
    with pytest.raises(RuntimeError, match="shards are recorded"):
        shards.check_shard_count(len(sizes) + 1, n, 300)


def test_manifest(spark, tmp_path):
    table = spark.createDataFrame(
        [(0, "a.wav", "a_offset_0.wav"), (1, "b.wav", ""), (2, "c.wav", None)],
        "row_id bigint, synth_file_path string, offset_file_path string",
    )
    manifest = job.build_manifest(table, "tempos", "MELSPEC", "abc", max_samples=2)
    rows = manifest.orderBy("row_id").collect()
    assert [r["audio_file_path"] for r in rows] == ["a_offset_0.wav", "b.wav", "c.wav"]
    assert [r["dataset_shard"] for r in rows] == [0, 0, 1]
    assert job.flat_manifest(manifest).columns[-3:] == [f"details.{c}" for c in table.columns]
    path = str(tmp_path / "manifest")
    sinks.write_manifest(manifest, path)
    assert [r["row_id"] for r in tables.manifest(spark, path, "tempos", "abc", shard=1).collect()] == [2]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_manifest(manifest, path)


def samples(spark, n=10):
    ids = spark.range(n).withColumnRenamed("id", "row_id")
    signals = ids.withColumn("samples", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i * (F.col("row_id") + 1)).cast("float")))
    manifest = job.build_manifest(ids.withColumn("synth_file_path", F.lit("a.wav")), "d", "MELSPEC", "m", max_samples=4)
    return manifest, signals


def test_job_resumes_after_a_failure(spark, tmp_path):
    manifest, signals = samples(spark)
    store, log = str(tmp_path / "store"), str(tmp_path / "log")

    def failing():
        def model(rows):
            raise ValueError("no model")
        return model

    with pytest.raises(Exception, match="no model"):
        job.run_job(manifest, signals, store, log, failing, "d", "m")
    assert {r["status"] for r in latest(spark, log)} == {"failed"}
    # One shard is done elsewhere; the next run does only the others.
    early = job.extract(signals.filter("row_id < 4"), job.moment_extractor(2))
    sinks.append_embeddings(early.select(F.lit("d").alias("dataset"), F.lit("m").alias("model_hash"), F.lit(0).alias("layer"), "row_id", "embedding"), store)
    assert job.run_job(manifest, signals, store, log, job.moment_extractor(2), "d", "m") == 10
    assert job.run_job(manifest, signals, store, log, job.moment_extractor(2), "d", "m") == 10
    rows = tables.embeddings(spark, store, "d", "m", layer=0)
    assert rows.select("row_id").distinct().count() == rows.count() == 10
    assert {r["shard"]: r["status"] for r in latest(spark, log)} == {0: "done", 1: "done", 2: "done"}
    assert guards.blank_counts(rows, "embedding").first()["n_blank"] == 0


def test_job_is_honest_about_what_is_missing(spark, tmp_path):
    """Silent, missing and short samples; three runs leave the same store."""
    manifest, signals = samples(spark)
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    silent = F.when(F.col("row_id") == 1, F.transform("samples", lambda x: x * 0)).when(F.col("row_id") == 9, F.slice("samples", 1, 2))
    signals = signals.filter("row_id <> 5").withColumn("samples", F.coalesce(silent, F.col("samples")))
    run = lambda **k: job.run_job(manifest, signals, store, log, job.moment_extractor(2), "d", "m", minimum_seconds=1.0, rate=8, **k)
    assert run(only_shards=[0]) == 4
    assert {r["shard"]: r["status"] for r in latest(spark, log)} == {0: "done"}
    assert [run(), run()] == [8, 8]
    rows = tables.embeddings(spark, store, "d", "m", layer=0)
    assert sorted(r["row_id"] for r in rows.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert {r["shard"]: r["status"] for r in latest(spark, log)} == {0: "done", 1: "failed", 2: "failed"}
    assert job.failed_shards(spark, log, "d", "m") == [1, 2]
    with pytest.raises(RuntimeError, match="10 rows but the store has 8"):
        job.check_store(manifest, rows, max_samples=4)
    asked = []
    plan = spark.createDataFrame([("d", "m", "repair"), ("e", "m", "extract"), ("f", "m", "done")], "dataset string, model_hash string, action string")
    assert job.run_planned(plan, log, lambda *a: asked.append(a)) == 2 and asked == [("d", "m", [1, 2]), ("e", "m", None)]


def test_layers_of_a_matrix_are_stored_apart(spark, tmp_path):
    manifest, signals = samples(spark)
    store = str(tmp_path / "store")

    def load():
        return lambda rows: [[[float(layer), float(len(r))] for layer in range(3)] for r in rows]

    for _ in range(2):
        assert job.run_job(manifest, signals, store, str(tmp_path / "log"), load, "d", "m", layered=True) == 30
    second = tables.embeddings(spark, store, "d", "m", layer=2)
    assert {tuple(r["embedding"]) for r in second.collect()} == {(2.0, 8.0)}
    job.check_store(manifest, second, max_samples=4)


def latest(spark, log):
    return spark.read.parquet(log).groupBy("shard").agg(F.max_by("status", "ts").alias("status")).collect()


def test_blank_vectors_are_pending(spark):
    manifest, _ = samples(spark, 3)
    store = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 1.0])], "row_id bigint, embedding array<float>")
    assert sorted(r["row_id"] for r in job.pending(manifest, store).collect()) == [0, 2]


def test_extractor_loads_once_per_task(spark):
    _, signals = samples(spark, 100)

    def load():
        calls = []

        def model(rows):
            calls.append(len(rows))
            return [[float(len(calls))] for _ in rows]

        return model

    made = job.extract(signals.coalesce(1), load, batch_rows=30).collect()
    assert sorted({r["embedding"][0] for r in made}) == [1.0, 2.0, 3.0, 4.0]


def test_status_rules(spark):
    now = dt.datetime(2024, 1, 2, 12)
    hours = lambda h: now - dt.timedelta(hours=h)
    log = spark.createDataFrame(
        [(0, "in progress", hours(9)), (0, "done", hours(8)), (1, "in progress", hours(7)), (2, "in progress", hours(1)),
         (3, "failed", hours(3)), (3, "in progress", hours(2))],
        "shard int, status string, ts timestamp",
    )
    every = spark.range(5).select(F.col("id").cast("int").alias("shard"))
    got = {r["shard"]: r["status"] for r in shards.latest_status(log, every, F.lit(now), ["shard"]).collect()}
    assert got == {0: "done", 1: "failed", 2: "in progress", 3: "in progress", 4: "never started"}


def test_run_plan(spark):
    grid_ = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run string")
    statuses = spark.createDataFrame(
        [("a", 0, "done"), ("a", 1, "done"), ("b", 0, "done"), ("b", 1, "failed"), ("c", 0, "in progress")],
        "run string, shard int, status string",
    )
    plan = {r["run"]: r["action"] for r in shards.plan_runs(grid_, statuses, ["run"]).collect()}
    assert plan == {"a": "done", "b": "repair", "c": "wait", "d": "extract"}
    assert [tuple(r) for r in shards.failed_shards(statuses).collect()] == [("b", 1)]


def test_embedding_store_replaces_only_its_folders(spark, tmp_path):
    store = str(tmp_path / "store")
    row = lambda layer, value: spark.range(3).select(
        F.lit("d").alias("dataset"), F.lit("m").alias("model_hash"), F.lit(layer).alias("layer"),
        F.col("id").alias("row_id"), F.array(F.lit(value).cast("float")).alias("embedding"),
    )
    sinks.append_embeddings(row(0, 1.0).unionByName(row(1, 1.0)), store)
    sinks.replace_embeddings(row(1, 2.0), store)
    got = {(r["layer"], r["embedding"][0]) for r in spark.read.parquet(store).collect()}
    assert got == {(0, 1.0), (1, 2.0)}
    wanted = spark.createDataFrame([(2,)], "row_id bigint")
    assert tables.embeddings(spark, store, "d", "m", 1, wanted).count() == 1
    plan = tables.embeddings(spark, store, "d", "m", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_model_configs_and_exports(spark, tmp_path):
    path = str(tmp_path / "configs")
    config = configs.model_config("JUKEBOX", 4)
    checksum = sinks.save_model_config(spark, "notes", config, path)
    assert tables.model_config(spark, path, "notes", checksum) == config
    assert config["decoder_hidden_states"] is False
    with pytest.raises(ValueError, match="no configuration"):
        tables.model_config(spark, path, "notes", "nothing")
    for name in (f"notes_JUKEBOX_{checksum}.zarr", f"chords_JUKEBOX_{checksum}.zarr"):
        (tmp_path / "exports" / name).mkdir(parents=True)
    known = spark.createDataFrame([(checksum, "JUKEBOX", [9936, 72, 4800])], "model_hash string, model_name string, shape array<int>")
    found = tables.exports(spark, str(tmp_path / "exports"), "notes", known, "zarr").collect()
    assert [(r["model_hash"], r["model_size"], r["model_type"], r["shape"][1]) for r in found] == [(checksum, "L", "JUKEBOX", 72)]


def test_file_checksums(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_text("hello world")
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(b"hello world"))
    for name, gunzip in (("a.txt", False), ("a.txt.gz", True)):
        row = tables.file_checksums(spark, str(tmp_path / name), gunzip=gunzip).first()
        assert row["checksum"] == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"


def test_run_config(spark, tmp_path):
    run = {"models": list(dims.fv.MODEL_LAYERS), "concepts": list(dims.fv.CONCEPT_LABELS), "settings": {"minimum_duration_in_sec": 4}}
    path = tmp_path / "run.json"
    path.write_text(json.dumps(run))
    pairs = configs.run_pairs(spark, configs.load_run_config(str(path)))
    assert pairs.count() == 63
    assert pairs.filter("model_name = 'JUKEBOX'").select("model_hash").distinct().count() == 1


def test_probe_config():
    base = {"dataset_embeddings_label_column_name": "something", "dataset": "test", "num_outputs": 10, "model_hash": "xyz"}
    cfg = configs.ProbeConfig(base, max_num_epochs=100, seed=42, load_embeddings_in_memory=True)
    assert cfg["batch_size"] == 64
    assert cfg.uid() == "23f4db03a995b56bc70d62dd5453670c68ea8654"
    with pytest.raises(ValueError, match="dataset is required"):
        configs.ProbeConfig({k: v for k, v in base.items() if k != "dataset"})
    with pytest.raises(ValueError, match="bad_param is no parameter"):
        configs.ProbeConfig(base, bad_param=1)
    with pytest.raises(ValueError, match="seed cannot be written as JSON"):
        configs.ProbeConfig(base, seed={1, 2})
    with pytest.raises(ValueError, match="must end the training"):
        configs.ProbeConfig(base, early_stopping=False)


def test_probe_config_of_a_sweep_row():
    cfg = configs.probe_config("chords", "MUSICGEN_DECODER", "L", 10)
    assert cfg["hidden_layer_sizes"] == [512] and cfg["num_outputs"] == 4
    assert cfg["model_hash"] == "MUSICGEN_DECODER-L-10" and cfg["load_embeddings_in_memory"]
    tempos = configs.probe_config("tempos", "MFCC", "L", 0, hidden_layer_sizes=(), learning_rate=1e-4)
    assert tempos["num_outputs"] == 1 and tempos["hidden_layer_sizes"] == [] and tempos["learning_rate"] == 1e-4
    assert not configs.probe_config("intervals", "MFCC", "L", 0)["load_embeddings_in_memory"]


@pytest.mark.parametrize("change", [
    {}, {"dataset": ...}, {"bad_param": 1}, {"early_stopping": False}, {"early_stopping": False, "max_num_epochs": 3}, {"max_num_epochs": 0},
    {"early_stopping": None, "model_hash": ..., "other": {"a": 1}}, {"early_stopping": 0, "max_num_epochs": 0},
])
def test_stored_configs_have_the_faults_of_given_ones(spark, change):
    base = {"dataset_embeddings_label_column_name": "something", "dataset": "test", "num_outputs": 10, "model_hash": "xyz"}
    given = {k: v for k, v in (base | change).items() if v is not ...}
    row = spark.createDataFrame([(json.dumps(given),)], "config string").select(configs.config_faults(F.col("config")).alias("faults"))
    assert row.first()["faults"] == configs.probe_faults(given)


def test_text_that_is_no_config(spark):
    rows = spark.createDataFrame([(None,), ("",), ("[1]",), ("{",)], "config string")
    assert [r[0] for r in rows.select(configs.config_faults(F.col("config"))).collect()] == [["is no JSON object"]] * 4


def signals(spark, n=400):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 30).alias("n"), (F.col("id") % 5 == 0).alias("is_silent"))


def test_counts_are_observed_on_the_write(spark, tmp_path):
    """Every row is made once: an accumulator in the plan sees as many as there are."""
    passed = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    df = signals(spark)
    with pytest.warns(UserWarning) as told:
        counts = publishing.publish_dataset(
            df.mapInArrow(through, df.schema), str(tmp_path / "t"), publishing.long_enough(F.col("n"), 10, 1.0)
        )
    kept = [i for i in range(400) if i % 30 >= 10]
    assert counts == {"n": 400, "n_kept": len(kept), "n_rejected": 400 - len(kept), "n_silent": sum(i % 5 == 0 for i in kept)}
    assert passed.value == 400
    assert sorted(r["row_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == kept
    assert [str(w.message).split(" at ")[0] for w in told] == [f"{counts['n_silent']} of {len(kept)} samples are silent".split(" are")[0],
                                                              f"{counts['n_rejected']} of 400 samples were rejected and are not"]


def test_counts_of_sound_empty_and_null_rows(spark, tmp_path, recwarn):
    sound = signals(spark).withColumn("is_silent", F.lit(None).cast("boolean"))
    assert publishing.publish_dataset(sound, str(tmp_path / "a")) == {"n": 400, "n_kept": 400, "n_rejected": 0, "n_silent": 0}
    assert publishing.publish_dataset(sound.limit(0), str(tmp_path / "b"))["n"] == 0
    assert spark.read.parquet(str(tmp_path / "b")).columns == sound.columns
    assert not [w for w in recwarn if issubclass(w.category, UserWarning)]
    unknown = sound.withColumn("n", F.lit(None).cast("int"))
    with pytest.warns(UserWarning, match="400 of 400 samples were rejected"):
        assert publishing.publish_dataset(unknown, str(tmp_path / "c"), publishing.long_enough(F.col("n"), 10, 1.0))["n_rejected"] == 400


def test_a_failing_publish_counts_nothing(spark, tmp_path):
    df = signals(spark).withColumn("n", F.when(F.col("row_id") < 300, F.col("n")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        publishing.publish_dataset(df, str(tmp_path / "t"))
    assert list(tmp_path.iterdir()) == []

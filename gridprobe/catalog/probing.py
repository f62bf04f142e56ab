"""Fitted probes and streams. The SQL of a fit gives its rows, and that its metrics lie in their bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridprobe.catalog.labelling import CELLS, split_sql
from gridprobe.catalog.registry import query, reader, rounded
from gridprobe.catalog.signals import MOMENTS
from gridprobe.operators import gram, labels, sweeps
from gridprobe.operators.unnest import unnest
from gridprobe.plans import embedding_job as job
from gridprobe.plans import probes, sweep, trainer
from gridprobe.session import scratch_path
from gridprobe.sources import sinks, tables
from gridprobe.sources.configs import ProbeConfig
from gridprobe.streaming import incremental_extract, online_stats


def config(outputs: int = 10, **hyper) -> ProbeConfig:
    return ProbeConfig(
        dataset="vectors", dataset_embeddings_label_column_name="label", model_hash="abc", num_outputs=outputs, **hyper
    )


def class_rows(spark, sf):
    vectors = reader(spark, sf)("embeddings").withColumnRenamed("vec_id", "row_id")
    return probes.assemble(vectors.select("row_id", "label"), vectors, "label", "multiclass")


def value_rows(spark, sf):
    """The mean of a vector as a regression label."""
    from gridprobe.functions import signal

    vectors = reader(spark, sf)("embeddings").withColumnRenamed("vec_id", "row_id")
    label = signal.mean(signal.widen(F.col("embedding")))
    return probes.assemble(vectors.select("row_id", label.alias("value")), vectors, "value", "regression")


def _fit(rows, cfg, output_type):
    return probes.fit(rows.filter("split = 'train'"), cfg, output_type)


SPLIT_SIZES = f"WITH {split_sql(0)} SELECT split, count(*) AS n, TRUE AS in_band FROM divided GROUP BY split"


def _in_band(metric_rows, largest):
    """Rows per split, and whether the metrics are sound: a finite loss, an accuracy between 0 and 1 that equals the
    F1 of single labels, and on the training rows one at least as high as always naming the largest class."""
    sound = (
        ~F.isnan("loss") & (F.col("loss") >= 0) & F.col("accuracy").between(0, 1) & (F.abs(F.col("accuracy") - F.col("f1")) < 1e-9)
        & ((F.col("split") != "train") | (F.col("accuracy") >= largest))
    )
    return metric_rows.select("split", "n", sound.alias("in_band"))


def _largest_share(rows):
    counts = rows.filter("split = 'train'").groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n") / F.sum("n")).first()[0]


@query("M1 M2 M5 M6 A3", SPLIT_SIZES)
def linear_probe(spark, sf):
    rows = class_rows(spark, sf)
    fitted = probes.evaluate(_fit(rows, config(), "multiclass"), rows, "split")
    return _in_band(fitted, _largest_share(rows))


@query("M3 M5 M6", SPLIT_SIZES)
def hidden_layer_probe(spark, sf):
    rows = class_rows(spark, sf)
    fitted = probes.evaluate(_fit(rows, config(hidden_layer_sizes=[512]), "multiclass"), rows, "split")
    return _in_band(fitted, _largest_share(rows))


@query("M4 M5 M6 A2 W6", "SELECT count(*) AS n, 3 AS splits, TRUE AS in_band FROM embeddings")
def regression_probe(spark, sf):
    """The label is a linear function of the vector, so the fit must explain it in every split."""
    rows = value_rows(spark, sf)
    fitted = probes.evaluate(_fit(rows, config(1), "regression"), rows, "split")
    return fitted.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("splits"), (F.min("r2") > 0.99).alias("in_band")
    )


# Ridge regression by elimination: the sums of products per split, and one pivot per step on the training rows' system.
_RIDGE = f"""
WITH RECURSIVE {split_sql(0)},
z AS (
    SELECT split, list_concat([CAST(1 AS DOUBLE)], list_transform(embedding, lambda x: CAST(x AS DOUBLE)),
           [CAST(CAST((label - lo) / CAST(hi - lo AS DOUBLE) AS FLOAT) AS DOUBLE)]) AS z
    FROM divided, (SELECT min(label) AS lo, max(label) AS hi FROM embeddings)
),
cells AS (SELECT split, i, j, avg(z[i] * z[j]) AS p, count(*) AS n FROM z, range(1, 67) a(i), range(1, 67) b(j) GROUP BY split, i, j),
spread AS (
    SELECT c.split, c.n, c.i - 1 AS i, c.j - 1 AS j, c.p - a.p * b.p AS p, a.p AS mean
    FROM cells c JOIN cells a ON a.split = c.split AND a.i = c.i AND a.j = 1 JOIN cells b ON b.split = c.split AND b.i = c.j AND b.j = 1
    WHERE c.i > 1 AND c.j > 1
),
settings AS (SELECT * FROM (VALUES (CAST(0.0001 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) d(decay), (VALUES (TRUE), (FALSE)) t(standardised)),
scales AS (SELECT standardised, i, CASE WHEN standardised AND p > 0 THEN sqrt(p) ELSE 1 END AS s
           FROM spread, (SELECT DISTINCT standardised FROM settings) WHERE split = 'train' AND i = j AND i <= 64),
system AS (
    SELECT decay, standardised, s.i, list(s.p / (a.s * coalesce(b.s, 1)) + CASE WHEN s.i = s.j THEN decay ELSE 0 END ORDER BY s.j) AS cells
    FROM settings JOIN scales a USING (standardised) JOIN spread s ON s.split = 'train' AND s.i = a.i
    LEFT JOIN scales b ON b.standardised = settings.standardised AND b.i = s.j GROUP BY decay, standardised, s.i
),
solved AS (
    SELECT decay, standardised, 0 AS step, list(cells ORDER BY i) AS m FROM system GROUP BY decay, standardised
    UNION ALL
    SELECT decay, standardised, step + 1,
           list_transform(m, lambda r, i: CASE WHEN i = step + 1 THEN list_transform(r, lambda x: x / r[step + 1])
               ELSE list_transform(r, lambda x, j: x - r[step + 1] / m[step + 1][step + 1] * m[step + 1][j]) END)
    FROM solved WHERE step < 64
),
weights AS (
    SELECT f.decay, f.standardised, s.i, f.m[s.i][65] / s.s AS w
    FROM solved f JOIN scales s ON s.standardised = f.standardised WHERE f.step = 64
    UNION ALL SELECT decay, standardised, 65, -1 FROM settings
),
gaps AS (
    SELECT decay, standardised, split, sum(w * mean) AS gap FROM weights JOIN spread USING (i) WHERE j = 1 GROUP BY decay, standardised, split
),
losses AS (
    SELECT a.decay, a.standardised, s.split, max(n) AS n, sum(a.w * b.w * p) AS v, max(CASE WHEN s.i = 65 AND s.j = 65 THEN p END) AS total
    FROM weights a JOIN weights b ON a.decay = b.decay AND a.standardised = b.standardised JOIN spread s ON s.i = a.i AND s.j = b.i
    GROUP BY a.decay, a.standardised, s.split
)
SELECT l.decay, l.standardised, l.split, n, round(v + (g.gap - t.gap) * (g.gap - t.gap), 6) + 0.0 AS loss,
       round(1 - (v + (g.gap - t.gap) * (g.gap - t.gap)) / total, 6) + 0.0 AS r2
FROM losses l JOIN gaps g ON g.decay = l.decay AND g.standardised = l.standardised AND g.split = l.split
JOIN gaps t ON t.decay = l.decay AND t.standardised = l.standardised AND t.split = 'train'
"""


@query("M4 M5 M6 A2 A3 A7 A8", _RIDGE)
def ridge_probes(spark, sf):
    """Four regression probes of the scaled label from one reading of the vectors: loss and R2 per split."""
    vectors = reader(spark, sf)("embeddings").withColumnRenamed("vec_id", "row_id")
    rows = probes.assemble(vectors.select("row_id", "label"), vectors, "label", "regression", extrapolate=False)
    scores = gram.ridge_scores(gram.gram(rows), [1e-4, 1e-1])
    return scores.select("decay", "standardised", "split", "n", rounded(F.col("loss")).alias("loss"), rounded(F.col("r2")).alias("r2"))


def trained_config(outputs: int, **hyper) -> ProbeConfig:
    return config(outputs, **{"max_num_epochs": 12, "early_stopping_boredom": 4} | hyper)


def _trained(rows, configs, output_type):
    """(probe, split, n, loss, main): the metrics of probes trained together, in the order of their configurations."""
    made = trainer.train(rows, configs, output_type)
    flat = [
        (k, split, int(m["n"]), m["loss"], m["primary"], len(p.log))
        for k, p in enumerate(made) for split, m in p.metrics.items()
    ]
    return rows.sparkSession.createDataFrame(flat, "probe int, split string, n long, loss double, main double, evaluations int")


@query("M2 M3 M5 M6 E8 A9 W8")
def trained_probes(spark, sf):
    """A linear and a hidden-layer probe by mini-batches with dropout, stopped early: loss and accuracy per split."""
    return _trained(class_rows(spark, sf), [trained_config(10), trained_config(10, hidden_layer_sizes=[512])], "multiclass")


@query("M4 M3 M6 E8 A8 W6")
def trained_regression(spark, sf):
    """The same for a label that is a linear function of the vector: loss and R2 per split."""
    given = [trained_config(1, dropout_p=0.0, learning_rate=1e-2, early_stopping_metric="-loss"),
             trained_config(1, hidden_layer_sizes=[32], dropout_p=0.25, l2_weight_decay=1e-4)]
    return _trained(value_rows(spark, sf), given, "regression")


@query("M7 M9 G9 K7 F7")
def trained_sweep(spark, sf):
    """The 216 settings of the handcrafted grid for one export, in shared scans, each with metrics of its own."""
    rows = class_rows(spark, sf)
    grid = sweeps.sweep(spark, "handcrafted").filter("concept = 'chords' AND model_type = 'MFCC'").withColumn("num_classes", F.lit(10))
    exports = spark.createDataFrame([("a", "chords", "L", "MFCC", 1)], "path string, concept string, model_size string, model_type string, n_layers int")
    return sweep.run_sweep(
        spark, grid, exports, lambda *_: rows, scratch_path(spark, "metrics"), solver="adam", max_num_epochs=2, early_stopping=False
    )


@query("M6 A6 M2")
def trained_confusion(spark, sf):
    """The cells of a trained probe's confusion matrix on the validation rows."""
    rows = class_rows(spark, sf)
    probe = trainer.train(rows, [trained_config(10)], "multiclass")[0]
    return probes.confusion(probe, rows.filter("split = 'valid'"))


@query("M6 A6 M2", f"WITH {split_sql(0)} SELECT label, count(*) AS n FROM divided WHERE split = 'valid' GROUP BY label")
def probe_confusion(spark, sf):
    """The rows of a fitted probe's confusion matrix add up to the labels of the split."""
    rows = class_rows(spark, sf)
    cells = probes.confusion(_fit(rows, config(), "multiclass"), rows.filter("split = 'valid'"))
    found = cells.groupBy("label").agg(F.sum("n").alias("n")).filter("n > 0")
    coded = labels.encode(reader(spark, sf)("embeddings").select("label").distinct(), "label", "code")
    return found.withColumnRenamed("label", "code").join(coded, "code").select("label", "n")


@query("M7 M9 K7 F7", f"""
WITH {split_sql(0)}, sizes AS (SELECT split, count(*) AS n FROM divided GROUP BY split),
runs AS (SELECT unnest(['chords', 'notes']) AS concept), layers AS (SELECT unnest([0, 1]) AS layer)
SELECT concept, layer, split, 8 AS configs, n, TRUE AS in_band FROM runs CROSS JOIN layers CROSS JOIN sizes""")
def probe_sweep(spark, sf):
    """A sweep over two concepts, two layers and eight settings, run twice; the second run adds nothing."""
    vectors = reader(spark, sf)("embeddings").withColumnRenamed("vec_id", "row_id")

    def load(concept, path, layer):
        label = F.col("label") if concept == "chords" else F.col("label") % 3
        half = vectors.select("row_id", F.slice("embedding", 1 + 32 * layer, 32).alias("embedding"))
        return probes.assemble(vectors.select("row_id", label.alias("label")), half, "label", "multiclass")

    grid = sweeps.expand_space(spark.range(32).withColumnRenamed("id", "config_id"), {
        "model_type": ("JUKEBOX",), "model_size": ("L",), "model_layer": (0, 1), "concept": ("chords", "notes"),
        "hidden_layer_sizes": ((),), "l2_weight_decay": (None, 1e-3), "learning_rate": (1e-3, 1e-4), "data_standardization": (True, False),
    }).withColumn("num_classes", F.when(F.col("concept") == "chords", 10).otherwise(3))
    exports = spark.createDataFrame(
        [("a", "chords", "L", "JUKEBOX", 72), ("b", "notes", "L", "JUKEBOX", 72)],
        "path string, concept string, model_size string, model_type string, n_layers int",
    )
    path = scratch_path(spark, "metrics")
    for _ in range(2):
        swept = sweep.run_sweep(spark, grid, exports, load, path)
    by = ["concept", "layer", "split"]
    seen = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    return swept.groupBy(*by).agg(
        F.count_distinct("uid").cast("int").alias("configs"), seen("n").cast("bigint").alias("n"),
        (seen("accuracy").between(0, 1) & (F.count(F.lit(1)) == F.count_distinct("uid", "metric"))).alias("in_band"),
    )


@query("K8 S10", SPLIT_SIZES)
def saved_probe(spark, sf):
    """Saved, loaded again by the start of its uid, and evaluated: the metrics are the same."""
    rows = class_rows(spark, sf)
    root = scratch_path(spark, "probes")
    fitted = _fit(rows, config(), "multiclass")
    uid = probes.save(spark, fitted, root)
    again = probes.evaluate(probes.load(spark, uid[:10], root), rows, "split")
    before = probes.evaluate(fitted, rows, "split").select("split", F.col("loss").alias("_loss"), F.col("accuracy").alias("_accuracy"))
    same = (F.abs(F.col("loss") - F.col("_loss")) < 1e-9) & (F.abs(F.col("accuracy") - F.col("_accuracy")) < 1e-9)
    return again.join(before, "split").select("split", "n", same.alias("in_band"))


@query("T1 A3", f"""
SELECT dim, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS deviation FROM ({CELLS}) GROUP BY dim""")
def streamed_dimension_statistics(spark, sf):
    stream = tables.table_stream(spark, sf, "embeddings")
    path, checkpoint = scratch_path(spark, "stats"), scratch_path(spark, "stats-checkpoint")
    online_stats.keep_latest(online_stats.dimension_stats(stream, "embedding"), path, checkpoint).awaitTermination()
    stats = online_stats.read_latest(spark, path)
    return stats.select("dim", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("deviation")).alias("deviation"))


@query("T1", """
SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS deviation FROM events GROUP BY event_type""")
def streamed_event_statistics(spark, sf):
    stream = tables.table_stream(spark, sf, "events")
    path, checkpoint = scratch_path(spark, "stats"), scratch_path(spark, "stats-checkpoint")
    online_stats.keep_latest(
        online_stats.value_stats(stream, "value", "event_type"), path, checkpoint
    ).awaitTermination()
    stats = online_stats.read_latest(spark, path)
    return stats.select("event_type", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("deviation")).alias("deviation"))


@query("T2 B3", f"""
WITH {MOMENTS} SELECT vec_id AS row_id, CAST(b * 8 + f AS INT) AS i, round(x, 4) + 0.0 AS x FROM blocks""")
def streamed_extraction(spark, sf):
    stream = tables.table_stream(spark, sf, "embeddings")
    signals = stream.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("samples"))
    path, checkpoint = scratch_path(spark, "vectors"), scratch_path(spark, "vectors-checkpoint")
    incremental_extract.extract_stream(signals, job.moment_extractor(8), path, checkpoint, element="double").awaitTermination()
    cells = unnest(spark.read.parquet(path), "embedding", "row_id")
    return cells.select("row_id", "i", rounded(F.col("x"), 4).alias("x"))

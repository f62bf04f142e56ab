"""Sample arrays and feature frames, on the embeddings table read as signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridprobe.catalog.registry import csv, query, reader, rounded, unit_sql
from gridprobe.functions import hashing, signal
from gridprobe.operators import guards, pooling
from gridprobe.operators.unnest import unnest
from gridprobe.sources import tables

WIDTH = 64
FRAMES = (8, 8)


def vectors(spark, sf):
    return reader(spark, sf)("embeddings")


def _cells(df, column, *keys):
    """One row per element, rounded."""
    cells = unnest(df, column, *keys)
    return cells.select(*keys, "i", rounded(F.col("x")).alias("x"))


CELLS = "SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)"


@query("X1 F6 A1", """
WITH muted AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN [0.0 for x in embedding] ELSE embedding END AS samples FROM embeddings)
SELECT count(*) AS n, count(*) FILTER (WHERE len(list_filter(samples, lambda x: x <> 0)) = 0) AS n_silent FROM muted""")
def silent_samples(spark, sf):
    muted = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
    df = vectors(spark, sf).withColumn("samples", muted.otherwise(F.col("embedding")))
    return guards.silent_count(df.withColumn("is_silent", signal.is_silent(F.col("samples"))))


@query("X2 S8", """
SELECT vec_id, CAST(i AS INT) AS i, round((CAST(embedding[i + 1] AS DOUBLE) + CAST(embedding[i + 33] AS DOUBLE)) / 2, 6) + 0.0 AS x
FROM embeddings, range(32) AS t(i)""")
def downmixed_channels(spark, sf):
    channels = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    df = vectors(spark, sf).withColumn("mono", signal.downmix(channels))
    return _cells(df, "mono", "vec_id")


@query("X3", f"""
WITH cells AS ({CELLS}), peaks AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) AS peak FROM cells)
SELECT vec_id, i, round(CASE WHEN peak > 0 THEN x / peak ELSE x END, 6) + 0.0 AS x FROM peaks""")
def peak_normalised(spark, sf):
    df = vectors(spark, sf).withColumn("samples", signal.peak_normalised(F.col("embedding")))
    return _cells(df, "samples", "vec_id")


@query("S8 X2 X3 X4", f"""
WITH cells AS ({CELLS}),
mono AS (SELECT a.vec_id, a.i, (a.x + b.x) / 2 AS x FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND b.i = a.i + 32 WHERE a.i < 24),
peaks AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) AS peak FROM mono)
SELECT vec_id, i, round(CASE WHEN peak > 0 THEN x / peak ELSE x END, 6) + 0.0 AS x FROM peaks""")
def loaded_signals(spark, sf):
    channels = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    df = tables.signals(vectors(spark, sf).withColumn("channels", channels), "channels", 16, 1.5)
    return _cells(df, "samples", "vec_id")


@query("X4 E2", """
SELECT vec_id, 48 AS n_kept, CAST(len(embedding) - 48 AS INT) AS removed,
       round(list_sum([CAST(x AS DOUBLE) for x in embedding[1:48]]), 6) + 0.0 AS total FROM embeddings""")
def head_trimmed(spark, sf):
    df = vectors(spark, sf).withColumn("t", signal.head_trim(F.col("embedding"), 48))
    return df.select(
        "vec_id", F.size("t.kept").alias("n_kept"), F.col("t.removed").alias("removed"),
        rounded(signal.total(signal.widen(F.col("t.kept")))).alias("total"),
    )


@query("X5 E2", f"""
WITH placed AS (SELECT vec_id, k, embedding, CAST(floor({unit_sql(100, 'vec_id', 'k')} * (len(embedding) - 16)) AS INT) AS start FROM embeddings, range(3) r(k))
SELECT vec_id, CAST(k AS INT) AS crop, start, round(list_sum([CAST(x AS DOUBLE) for x in embedding[start + 1:start + 16]]), 6) + 0.0 AS total FROM placed""")
def random_crops(spark, sf):
    df = vectors(spark, sf).withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(2))))
    unit = hashing.hash_unit(100, F.col("vec_id"), F.col("crop"))
    df = df.withColumn("u", unit).withColumn("c", signal.random_crop(F.col("embedding"), 16, F.col("u")))
    return df.select(
        "vec_id", "crop", F.col("c.start").alias("start"),
        rounded(signal.total(signal.widen(F.col("c.kept")))).alias("total"),
    )


@query("X6 E2", """
SELECT doc_id, length(text) / 100.0 AS seconds FROM documents WHERE length(text) / 100.0 < 4.0""")
def too_short_samples(spark, sf):
    """Characters stand for samples."""
    docs = reader(spark, sf)("documents").select("doc_id", F.length("text").alias("n_samples"))
    return guards.too_short(docs, F.col("n_samples"), 100, 4.0).select("doc_id", "seconds")


DIFFS = f"""cells AS (SELECT vec_id, i // 8 AS f, i % 8 AS t, x FROM ({CELLS})),
d1 AS (SELECT *, x - lag(x) OVER (PARTITION BY vec_id, f ORDER BY t) AS x1 FROM cells),
d2 AS (SELECT *, x1 - lag(x1) OVER (PARTITION BY vec_id, f ORDER BY t) AS x2 FROM d1)"""


@query("X7", f"""
WITH {DIFFS}
SELECT vec_id, CAST(f AS INT) AS feature, CAST(t - 2 AS INT) AS i, round(x2, 6) + 0.0 AS x FROM d2 WHERE x2 IS NOT NULL""")
def second_differences(spark, sf):
    matrix = signal.frames_by_feature(F.col("embedding"), *FRAMES)
    df = unnest(vectors(spark, sf), matrix, "vec_id", index="feature", value="row")
    return _cells(df.withColumn("d", signal.difference(F.col("row"), 2)), "d", "vec_id", "feature")


MOMENTS = f"""{DIFFS},
pooled AS (SELECT vec_id, f, avg(x) AS m0, stddev_pop(x) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2
           FROM d2 GROUP BY vec_id, f),
blocks AS (SELECT vec_id, f, unnest([m0, s0, m1, s1, m2, s2]) AS x, unnest(range(6)) AS b FROM pooled)"""


@query("X8", f"""
WITH {MOMENTS}
SELECT vec_id, CAST(b * 8 + f AS INT) AS i, round(x, 6) + 0.0 AS x FROM blocks""")
def moment_pooling(spark, sf):
    df = pooling.moment_vectors(vectors(spark, sf), "embedding", FRAMES, "moments")
    return _cells(df, "moments", "vec_id")


@query("X9 J2", """
SELECT vec_id, CAST(i AS INT) AS i, round(CASE WHEN i < 32 THEN CAST(embedding[i + 1] AS DOUBLE) WHEN i < 48 THEN 2 * CAST(embedding[i + 1] AS DOUBLE)
       ELSE -CAST(embedding[i + 1] AS DOUBLE) END, 6) + 0.0 AS x FROM embeddings, range(64) r(i)""")
def concatenated_features(spark, sf):
    df = vectors(spark, sf)
    wide = signal.widen(F.col("embedding"))
    parts = [
        df.select("vec_id", F.slice(wide, 1, 32).alias("v")),
        df.select("vec_id", F.transform(F.slice(wide, 33, 16), lambda x: x * 2).alias("v")),
        df.select("vec_id", F.transform(F.slice(wide, 49, 16), lambda x: -x).alias("v")),
    ]
    return _cells(pooling.concat_features(parts, "vec_id", "v", "all"), "all", "vec_id")


LAYERED = f"SELECT vec_id, i // 32 AS layer, i // 8 % 4 AS frame, i % 8 AS dim, x FROM ({CELLS})"


@query("X10", f"""
SELECT vec_id, CAST(layer AS INT) AS layer, CAST(dim AS INT) AS i, round(avg(x), 6) + 0.0 AS x FROM ({LAYERED}) GROUP BY ALL""")
def pooled_layers(spark, sf):
    frame = lambda layer, t: F.slice("embedding", layer * 32 + t * 8 + 1, 8)
    states = F.array(*[F.array(*[frame(layer, t) for t in range(4)]) for layer in range(2)])
    df = pooling.pool_layers(vectors(spark, sf).withColumn("states", states), "states", "vec_id")
    return _cells(df, "embedding", "vec_id", "layer")


@query("X10 S6", f"""
SELECT vec_id, CAST(layer AS INT) AS layer, CAST(dim AS INT) AS i, round(avg(x), 6) + 0.0 AS x FROM ({LAYERED}) WHERE layer = 1 GROUP BY ALL""")
def pooled_single_layer(spark, sf):
    frame = lambda layer, t: F.slice("embedding", layer * 32 + t * 8 + 1, 8)
    states = F.array(*[F.array(*[frame(layer, t) for t in range(4)]) for layer in range(2)])
    df = pooling.pool_layers(vectors(spark, sf).withColumn("states", states), "states", "vec_id", layer=1)
    return _cells(df, "embedding", "vec_id", "layer")


@query("X10", f"""
SELECT vec_id, CAST(layer AS INT) AS i, round(avg(x), 6) + 0.0 AS x FROM ({LAYERED}) GROUP BY ALL""")
def pooled_attentions(spark, sf):
    plane = lambda layer: F.array(*[F.slice("embedding", layer * 32 + t * 8 + 1, 8) for t in range(4)])
    df = vectors(spark, sf).withColumn("heads", signal.mean_over_two_axes(F.array(plane(0), plane(1))))
    return _cells(df, "heads", "vec_id")


@query("X10", f"""
SELECT CAST(layer AS INT) AS layer, CAST(dim AS INT) AS dim, round(avg(x), 6) + 0.0 AS mean FROM ({LAYERED}) GROUP BY ALL""")
def layer_means_long_form(spark, sf):
    cells = vectors(spark, sf).select(F.posexplode("embedding").alias("i", "x"))
    keyed = cells.select(F.floor(F.col("i") / 32).cast("int").alias("layer"), (F.col("i") % 8).alias("dim"),
                         F.col("x").cast("double").alias("x"))
    means = pooling.pool_long(keyed, "x", "layer", "dim")
    return means.select("layer", "dim", rounded(F.col("mean")).alias("mean"))


@query("B5 E8", """
SELECT label, CAST(min(len(embedding)) AS INT) AS min_dim, CAST(max(len(embedding)) AS INT) AS max_dim, min(len(embedding)) = max(len(embedding)) AS is_uniform
FROM embeddings GROUP BY label""")
def embedding_dimensions(spark, sf):
    return guards.dimension_range(vectors(spark, sf), "embedding", "label")


@query("A12 F5", """
WITH muted AS (SELECT label, CASE WHEN vec_id % 5 = 0 THEN [0.0 for x in embedding] ELSE embedding END AS v FROM embeddings)
SELECT label, count(*) AS n, count(*) FILTER (WHERE len(list_filter(v, lambda x: x <> 0)) = 0) AS n_blank FROM muted GROUP BY label""")
def blank_vectors(spark, sf):
    muted = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
    df = vectors(spark, sf).withColumn("v", muted.otherwise(F.col("embedding")))
    return guards.blank_counts(df, "v", "label")

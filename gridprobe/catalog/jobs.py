"""Manifests, shards, status logs, run plans and the export registry."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from gridprobe.catalog.registry import lit, nth, query, reader, rounded
from gridprobe.catalog.signals import FRAMES, MOMENTS
from gridprobe.functions import dims, signal
from gridprobe.functions import fixed_values as fv
from gridprobe.operators import permutation, registry, shards
from gridprobe.operators.unnest import unnest
from gridprobe.plans import embedding_job as job
from gridprobe.plans import publishing
from gridprobe.session import scratch_path
from gridprobe.sources import buckets, files, sinks, tables
from gridprobe.sources.configs import config_faults

MODELS = list(fv.MODEL_LAYERS)
CONCEPTS = list(fv.CONCEPT_LABELS)
PER_SHARD = fv.SAMPLES_PER_SHARD
STATUSES = ["in progress", "done", "failed"]


@query("A11 B1", f"""
SELECT CAST(o_orderkey // {PER_SHARD} AS INT) AS shard, count(*) AS n FROM orders GROUP BY ALL""")
def shard_sizes(spark, sf):
    return shards.shard_counts(reader(spark, sf)("orders"), "o_orderkey")


def samples(spark, sf):
    return reader(spark, sf)("documents").select(
        F.col("doc_id").alias("row_id"), "lang", "source", "n_chars",
        F.concat("source", F.lit(".wav")).alias("synth_file_path"),
        F.when(F.col("lang") == "en", F.concat("source", F.lit("_offset.wav"))).otherwise("").alias("offset_file_path"),
    )


@query("B1 B2 P18 P23 F4", f"""
SELECT doc_id AS row_id, 'MELSPEC' AS model_name, 'abc' AS model_config_checksum, 'documents' AS dataset_name, CAST(doc_id // {PER_SHARD} AS INT) AS dataset_shard,
       CASE WHEN lang = 'en' THEN source || '_offset.wav' ELSE source || '.wav' END AS audio_file_path, doc_id AS "details.row_id", lang AS "details.lang",
       source AS "details.source", n_chars AS "details.n_chars", source || '.wav' AS "details.synth_file_path",
       CASE WHEN lang = 'en' THEN source || '_offset.wav' ELSE '' END AS "details.offset_file_path"
FROM documents""")
def flat_manifest(spark, sf):
    return job.flat_manifest(job.build_manifest(samples(spark, sf), "documents", "MELSPEC", "abc"))


@query("K3 S3 F4", f"""
SELECT CAST(doc_id // {PER_SHARD} AS INT) AS dataset_shard, count(*) AS n, count(DISTINCT source) AS n_sources
FROM documents WHERE doc_id // {PER_SHARD} = 0 GROUP BY ALL""")
def written_manifest_shard(spark, sf):
    """The manifest is written once; reading one shard of it prunes by file statistics."""
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(job.build_manifest(samples(spark, sf), "documents", "MELSPEC", "abc"), path)
    rows = tables.manifest(spark, path, "documents", "abc", shard=0)
    return rows.groupBy("dataset_shard").agg(
        F.count("*").alias("n"), F.count_distinct("details.source").alias("n_sources")
    )


@query("J4 F5 B3", """
SELECT d.doc_id AS row_id FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id""")
def pending_samples(spark, sf):
    """Documents without a label stand for samples without a vector."""
    t = reader(spark, sf)
    manifest = job.build_manifest(samples(spark, sf), "documents", "MELSPEC", "abc").select("row_id", "dataset_shard")
    store = t("labels").select(F.col("doc_id").alias("row_id"), F.array(F.lit(1.0)).alias("embedding"))
    return job.pending(manifest, store).select("row_id")


@query("B3 X7 X8", f"""
WITH {MOMENTS} SELECT vec_id AS row_id, CAST(b * 8 + f AS INT) AS i, round(x, 6) + 0.0 AS x FROM blocks""")
def extracted_moments(spark, sf):
    vectors = reader(spark, sf)("embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    made = job.extract(vectors, job.moment_extractor(FRAMES[0]), signal="embedding", element="double")
    cells = unnest(made, "embedding", "row_id")
    return cells.select("row_id", "i", rounded(F.col("x")).alias("x"))


@query("B3 K4 K6 W7 F4 X6 E2", """
WITH samples AS (
  SELECT vec_id // 64 AS shard, vec_id < 200 AND vec_id % 50 IN (7, 13) AS lacking, vec_id < 200 AND vec_id % 50 = 11 AS silent FROM embeddings)
SELECT CAST(shard AS INT) AS shard, CASE WHEN bool_or(lacking) THEN 'failed' ELSE 'done' END AS status,
       CASE WHEN bool_or(lacking) THEN count(*) FILTER (WHERE lacking) || ' of ' || count(*) || ' samples have no vector' ELSE '' END AS message,
       count(*) FILTER (WHERE NOT lacking) AS n, count(*) FILTER (WHERE NOT lacking) AS n_distinct, count(*) FILTER (WHERE silent) AS n_blank
FROM samples GROUP BY shard""")
def resumed_job(spark, sf):
    """One shard, then all of them, then all again, over samples of which some are silent, missing or too short."""
    vectors = reader(spark, sf)("embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    manifest = job.build_manifest(
        vectors.select("row_id", F.lit("a.wav").alias("synth_file_path")), "vectors", "MELSPEC", "abc", max_samples=64
    )
    odd = lambda k: (F.col("row_id") < 200) & (F.col("row_id") % 50 == k)
    silent = F.transform("embedding", lambda x: x * 0)
    heard = F.when(odd(11), silent).when(odd(13), F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    signals = vectors.filter(~odd(7)).select("row_id", heard.alias("samples"))
    store, log = scratch_path(spark, "store"), scratch_path(spark, "status")
    for only in ([1], None, None):
        job.run_job(
            manifest, signals, store, log, job.moment_extractor(FRAMES[0]), "vectors", "abc", only_shards=only,
            minimum_seconds=2.0, rate=32,
        )
    last = spark.read.parquet(log).groupBy("shard").agg(F.max_by(F.struct("status", "message"), "ts").alias("l"))
    rows = spark.read.parquet(store).groupBy(shards.shard_of(F.col("row_id"), 64).alias("shard")).agg(
        F.count("*").alias("n"), F.count_distinct("row_id").alias("n_distinct"),
        F.count_if(job.vectors.is_blank(F.col("embedding"))).alias("n_blank"),
    )
    return last.join(rows, "shard").select("shard", "l.status", "l.message", "n", "n_distinct", "n_blank")


@query("K4 S6 E3", """
SELECT vec_id AS row_id,
       md5(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 1e6) AS BIGINT) AS VARCHAR)), ',')) AS digest
FROM embeddings WHERE label % 3 = 1""")
def stored_layer(spark, sf):
    """Vectors written under (dataset, model, layer) and read back for one layer. Every component counts."""
    path = scratch_path(spark, "store")
    sinks.append_embeddings(_stored(spark, sf), path)
    read = tables.embeddings(spark, path, "vectors", "abc", layer=1)
    return read.select("row_id", F.md5(F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("string")), ",")).alias("digest"))


# Event types as status words: errors failed, purchases are done, everything else is in progress.
STATUS_SQL = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'in progress' END"


def status_log(spark, sf):
    events = reader(spark, sf)("events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done")
    return events.select(
        F.col("user_id").alias("shard"), "event_id", "ts", status.otherwise("in progress").alias("status"),
        dims.pick(CONCEPTS, F.col("event_id") % 7).alias("concept"), dims.pick(MODELS, F.col("user_id") % 9).alias("model_name"),
        F.from_json("props", "k int")["k"].alias("part"),
    )


LATEST = f"""log AS (SELECT user_id AS shard, event_id, ts, {STATUS_SQL} AS status, (SELECT max(ts) FROM events) AS now FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts DESC, event_id DESC) AS r FROM log),
latest AS (SELECT shard, CASE WHEN status = 'in progress' AND (epoch_us(now) - epoch_us(ts)) // 1000000 > 6 * 3600 THEN 'failed' ELSE status END AS status
           FROM ranked WHERE r = 1)"""


@query("W7 S9 E4 P24 J4", f"""
WITH {LATEST}, ids AS (SELECT unnest(range((SELECT max(shard) + 10 FROM log))) AS shard)
SELECT i.shard, coalesce(l.status, 'never started') AS status FROM ids i LEFT JOIN latest l USING (shard)""")
def latest_shard_status(spark, sf):
    log = status_log(spark, sf)
    last = log.agg(F.max("shard")).first()[0]
    now = log.agg(F.max("ts").alias("now")).scalar()
    every = spark.range(last + 10).withColumnRenamed("id", "shard")
    return shards.latest_status(log, every, now, ["shard"], tie="event_id")


RUN_LOG = f"""log AS (SELECT {nth(CONCEPTS, 'event_id % 7')} AS concept, {nth(MODELS, 'user_id % 9')} AS model_name, CAST(json_extract(props, '$.k') AS INT) AS part,
         event_id, ts, {STATUS_SQL} AS status, (SELECT max(ts) FROM events) AS now FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY concept, model_name, part ORDER BY ts DESC, event_id DESC) AS r FROM log),
latest AS (SELECT concept, model_name, part, CASE WHEN status = 'in progress' AND (epoch_us(now) - epoch_us(ts)) // 1000000 > 6 * 3600 THEN 'failed' ELSE status END AS status
           FROM ranked WHERE r = 1)"""


def run_statuses(spark, sf):
    log = status_log(spark, sf)
    now = log.agg(F.max("ts").alias("now")).scalar()
    by = ["concept", "model_name", "part"]
    return shards.latest_status(log, log.select(*by).distinct(), now, by, tie="event_id")


@query("B4 G8 W7", f"""
WITH {RUN_LOG}, counted AS (
  SELECT concept, model_name, count(*) AS n_shards, count(*) FILTER (WHERE status = 'failed') AS n_failed,
         count(*) FILTER (WHERE status = 'in progress') AS n_in_progress, count(*) FILTER (WHERE status = 'done') AS n_done FROM latest GROUP BY ALL),
concepts AS (SELECT unnest({lit(CONCEPTS + ['timbre'])}) AS concept), models AS (SELECT unnest({lit(MODELS)}) AS model_name),
planned AS (SELECT c.concept, m.model_name, coalesce(n_shards, 0) AS n_shards, coalesce(n_failed, 0) AS n_failed, coalesce(n_in_progress, 0) AS n_in_progress, coalesce(n_done, 0) AS n_done
            FROM concepts c CROSS JOIN models m LEFT JOIN counted USING (concept, model_name))
SELECT *, CASE WHEN n_failed + n_in_progress + n_done = 0 THEN 'extract' WHEN n_failed > 0 THEN 'repair' WHEN n_done = n_shards THEN 'done' ELSE 'wait' END AS action
FROM planned""")
def run_plan(spark, sf):
    from gridprobe.operators.grid import dense_grid

    concepts = spark.createDataFrame([(c,) for c in CONCEPTS + ["timbre"]], "concept string")
    models = dims.models(spark).select("model_name")
    runs = dense_grid(spark, [(concepts, ["concept"]), (models, ["model_name"])], "run_id").drop("run_id")
    return shards.plan_runs(runs, run_statuses(spark, sf), ["concept", "model_name"])


@query("B4 W7", f"""
WITH {RUN_LOG} SELECT concept, model_name, part FROM latest WHERE status = 'failed'""")
def failed_run_shards(spark, sf):
    return shards.failed_shards(run_statuses(spark, sf))


FAMILIES = ["MUSICGEN_DECODER_LM", "MUSICGEN_DECODER", "JUKEBOX", "MELSPEC"]
SIZES = ["L", "M", "S"]


@query("F7 J6 P20", f"""
WITH configs AS (SELECT l_orderkey, l_linenumber, l_suppkey, {nth(CONCEPTS, 'l_partkey % 7')} AS concept, {nth(SIZES, 'l_suppkey % 3')} AS model_size, {nth(FAMILIES, 'l_orderkey % 4')} AS model_type,
                        CAST(l_quantity AS INT) AS model_layer FROM lineitem),
exports AS (SELECT p_name || '_' || p_partkey AS path, {nth(CONCEPTS, 'p_partkey // 12 % 7')} AS concept, {nth(SIZES, 'p_partkey % 3')} AS model_size, {nth(FAMILIES, 'p_partkey // 3 % 4')} AS model_type, p_size AS n_layers FROM part),
keyed AS (SELECT *, CASE WHEN model_type LIKE 'MUSICGEN_DECODER%' THEN split_part(model_type, '_LM', 1) ELSE model_type END AS k FROM configs),
ekeyed AS (SELECT *, CASE WHEN model_type LIKE 'MUSICGEN_DECODER%' THEN split_part(model_type, '_LM', 1) ELSE model_type END AS k FROM exports),
lookup AS (SELECT DISTINCT concept, model_size, k, model_layer FROM keyed),
answered AS (SELECT l.concept, l.model_size, l.k, l.model_layer, max(e.path) AS export_path
             FROM lookup l LEFT JOIN ekeyed e ON e.concept = l.concept AND e.model_size = l.model_size AND e.k = l.k AND e.n_layers > l.model_layer GROUP BY ALL)
SELECT c.l_orderkey, c.l_linenumber, c.l_suppkey, c.concept, c.model_size, c.model_type, c.model_layer, coalesce(a.export_path, 'none') AS export_path
FROM keyed c JOIN answered a USING (concept, model_size, k, model_layer)""")
def matched_exports(spark, sf):
    t = reader(spark, sf)
    configs = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", dims.pick(CONCEPTS, F.col("l_partkey") % 7).alias("concept"), dims.pick(SIZES, F.col("l_suppkey") % 3).alias("model_size"),
        dims.pick(FAMILIES, F.col("l_orderkey") % 4).alias("model_type"), F.col("l_quantity").cast("int").alias("model_layer"),
    )
    exports = t("part").select(
        F.concat_ws("_", "p_name", "p_partkey").alias("path"),
        dims.pick(CONCEPTS, F.floor(F.col("p_partkey") / 12) % 7).alias("concept"), dims.pick(SIZES, F.col("p_partkey") % 3).alias("model_size"),
        dims.pick(FAMILIES, F.floor(F.col("p_partkey") / 3) % 4).alias("model_type"), F.col("p_size").alias("n_layers"),
    )
    return registry.match_exports(configs, exports).fillna("none", "export_path")


@query("S5 P19 S4", f"""
WITH files AS (SELECT p_partkey, {nth(CONCEPTS, 'p_partkey % 7')} AS concept, {nth(MODELS, 'p_partkey % 9')} AS model_name, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 12) AS model_hash FROM part)
SELECT concept || '_' || model_name || '_' || model_hash || '.parquet' AS file_name, model_hash, model_name,
       CASE WHEN model_name LIKE 'MUSICGEN_DECODER%' THEN split_part(model_name, '_LM_', 2) ELSE 'L' END AS model_size,
       CASE WHEN model_name LIKE 'MUSICGEN_DECODER%' THEN 'MUSICGEN_DECODER' ELSE model_name END AS model_type
FROM files WHERE concept = 'notes'""")
def listed_exports(spark, sf):
    files = reader(spark, sf)("part").select(
        dims.pick(CONCEPTS, F.col("p_partkey") % 7).alias("concept"),
        dims.pick(MODELS, F.col("p_partkey") % 9).alias("model_name"),
        F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 12).alias("model_hash"),
    )
    name = F.concat(F.concat_ws("_", "concept", "model_name", "model_hash"), F.lit(".parquet"))
    paths = files.select(F.concat(F.lit("/data/"), name).alias("path"))
    found = registry.list_exports(paths, files.select("model_hash", "model_name"), "notes")
    return found.select("file_name", "model_hash", "model_name", "model_size", "model_type")


@query("M8", f"""
WITH firsts AS (SELECT unnest({lit(CONCEPTS)}) AS concept, unnest({lit([t[0][0] for t in fv.CONCEPT_LABELS.values()])}) AS classes,
                       unnest({lit([t[0][1] for t in fv.CONCEPT_LABELS.values()])}) AS label_column)
SELECT p_partkey, concept, label_column, CASE WHEN concept = 'tempos' THEN 'regression' ELSE 'multiclass' END AS output_type,
       CASE WHEN concept = 'tempos' THEN 1 ELSE classes END AS num_outputs
FROM part JOIN firsts ON concept = {nth(CONCEPTS, 'p_partkey % 7')}""")
def task_targets(spark, sf):
    df = reader(spark, sf)("part").select("p_partkey", dims.pick(CONCEPTS, F.col("p_partkey") % 7).alias("concept"))
    return registry.task_targets(df, "concept")


@query("E6", """
SELECT p_partkey, CAST(p_partkey % 150 AS INT) AS note FROM part WHERE p_partkey % 150 > 127""")
def notes_outside_range(spark, sf):
    from gridprobe.operators import guards

    notes = reader(spark, sf)("part").select("p_partkey", (F.col("p_partkey") % 150).cast("int").alias("note"))
    return guards.outside_midi_range(notes, "note")


def _stored(spark, sf):
    return reader(spark, sf)("embeddings").select(
        F.lit("vectors").alias("dataset"), F.lit("abc").alias("model_hash"), (F.col("label") % 3).alias("layer"),
        F.col("vec_id").alias("row_id"), "embedding",
    )


@query("E3 E4 B5 E5", """
SELECT CAST(vec_id // 64 AS INT) AS dataset_shard, count(*) AS n FROM embeddings GROUP BY ALL""")
def checked_store(spark, sf):
    """A manifest and a store that agree in rows, shards, vector length and ids; the check would raise otherwise."""
    rows = _stored(spark, sf).withColumn("layer", F.lit(0))
    manifest = job.build_manifest(
        rows.select("row_id", F.lit("a.wav").alias("synth_file_path")), "vectors", "MELSPEC", "abc", max_samples=64
    )
    path = scratch_path(spark, "store")
    sinks.append_embeddings(rows, path)
    store = tables.embeddings(spark, path, "vectors", "abc", layer=0)
    job.check_store(manifest, store, max_samples=64)
    return manifest.join(store.select("row_id"), "row_id").groupBy("dataset_shard").agg(F.count(F.lit(1)).alias("n"))


@query("E1 S6", """
SELECT label % 3 AS layer, vec_id AS row_id,
       md5(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 1e6 * CASE WHEN label % 3 = 1 THEN -1 ELSE 1 END) AS BIGINT) AS VARCHAR)), ',')) AS digest
FROM embeddings""")
def replaced_layer(spark, sf):
    """One layer of a store is rewritten; the others stay as they are. Every component counts."""
    rows = _stored(spark, sf)
    path = scratch_path(spark, "store")
    sinks.append_embeddings(rows, path)
    negated = rows.filter("layer = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    sinks.replace_embeddings(negated, path)
    stored = tables.embeddings(spark, path, "vectors", "abc")
    digits = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("string"))
    return stored.select("layer", "row_id", F.md5(F.array_join(digits, ",")).alias("digest"))


@query("S4 K5 P21", """
SELECT lang AS dataset, count(*) AS n_documents, max(n_chars) AS longest FROM documents GROUP BY lang""")
def stored_configs(spark, sf):
    """A configuration per dataset, made from its rows, stored under its checksum in one write and looked up in one join."""
    found = reader(spark, sf)("documents").groupBy(F.col("lang").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.max("n_chars").alias("longest")
    )
    # The canonical form: keys in order, two spaces.
    config = F.format_string('{\n  "longest": %d,\n  "n_documents": %d\n}', "longest", "n_documents")
    path = scratch_path(spark, "configs")
    wanted = sinks.save_model_configs(found.select("dataset", config.alias("config")), path).select("dataset", "model_hash")
    back = tables.model_configs(spark, path, wanted)
    values = F.from_json("config", "n_documents long, longest long")
    return back.select("dataset", values["n_documents"].alias("n_documents"), values["longest"].alias("longest"))


@query("S2 K2 G1", """
SELECT o_orderkey AS row_id, CAST(o_orderkey // 92 % 108 % 12 AS INT) AS root_note_pitch_class FROM orders""")
def published_dataset(spark, sf):
    """The notes whose ids are order keys, published and read back with the dataset's schema."""
    from gridprobe import schemas
    from gridprobe.catalog.grids import order_ids
    from gridprobe.plans import datasets as ds

    made = ds.notes(order_ids(spark, sf))
    have = set(made.columns)
    wanted = [part.split() for part in schemas.DATASETS["notes"].split(", ")]
    full = made.select(*[(F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in wanted])
    path = scratch_path(spark, "notes")
    sinks.publish(full, path)
    return tables.dataset_table(spark, "notes", path).select("row_id", "root_note_pitch_class")


@query("S5 P19 F7", """
SELECT 'vectors-' || CAST(label % 4 AS VARCHAR) AS dataset, 'abc' AS model_hash, count(*) AS n, 2 AS n_layers, 32 AS width, 'FLOAT' AS kind
FROM embeddings GROUP BY label % 4""")
def stored_shapes(spark, sf):
    """Rows, layers and width of stored exports, read from the footers of their files."""
    vectors = reader(spark, sf)("embeddings").withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = vectors.select(
        F.concat(F.lit("vectors-"), (F.col("label") % 4).cast("string")).alias("dataset"), F.lit("abc").alias("model_hash"), "layer",
        F.col("vec_id").alias("row_id"), F.slice("embedding", 1 + 32 * F.col("layer"), F.lit(32)).alias("embedding"),
    )
    path = scratch_path(spark, "store")
    sinks.append_embeddings(rows, path)
    return files.store_shapes(spark, path).drop("bytes")


_BLOCKS = """
SELECT CAST(o_orderkey // 5000 AS BIGINT) AS block,
       {}(string_agg(CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS checksum
FROM orders GROUP BY ALL"""


def _order_files(spark, sf, compression):
    """The orders as text files, one per block of keys, in the order of the keys."""
    lines = reader(spark, sf)("orders").select(
        F.floor(F.col("o_orderkey") / 5000).alias("block"), "o_orderkey", F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("value")
    )
    path = scratch_path(spark, "lines")
    ordered = lines.repartition("block").sortWithinPartitions("block", "o_orderkey").select("block", "value")
    ordered.write.option("compression", compression).partitionBy("block").text(path)
    return path


@query("P22", _BLOCKS.format("sha256"))
def file_digests(spark, sf):
    """Checksums of written files, read chunk by chunk."""
    found = files.digests(spark, _order_files(spark, sf, "none"), names="part-*", chunk=4096)
    return found.select(F.regexp_extract("path", "/block=([0-9]+)", 1).cast("long").alias("block"), "checksum")


@query("P22", _BLOCKS.format("md5"))
def unpacked_file_digests(spark, sf):
    """The same of compressed files, of what they unpack to."""
    found = files.digests(spark, _order_files(spark, sf, "gzip"), "md5", gunzip=True, names="part-*")
    return found.select(F.regexp_extract("path", "/block=([0-9]+)", 1).cast("long").alias("block"), "checksum")


_SIZE = "(SELECT count(*) FROM embeddings)"
_BITS = "(SELECT greatest(1, CAST(ceil(length(ltrim(bin(greatest(count(*) - 1, 1)), '0')) / 2.0) AS INTEGER)) FROM embeddings)"


@query("O4", f"""
WITH RECURSIVE {permutation.permuted_sql('SELECT vec_id AS pos FROM embeddings', _SIZE, _BITS, 7)}
SELECT pos AS vec_id, CAST(value // 64 AS BIGINT) AS step, CAST(value % 64 AS BIGINT) AS place FROM walk_out""")
def permuted_batches(spark, sf):
    """The batch of 64, and the place in it, that every row has in an epoch: arithmetic on dense ids, without a sort."""
    rows = reader(spark, sf)("embeddings").select("vec_id")
    slot = permutation.permuted(F.col("vec_id"), rows.count(), 7)
    return rows.select("vec_id", F.floor(slot / 64).alias("step"), (slot % 64).alias("place"))


@query("O4 S6 K2", f"""
WITH RECURSIVE {permutation.permuted_sql('SELECT unnest(range(192, 256)) AS pos', _SIZE, _BITS, 7)}
SELECT vec_id, label, md5(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 1e6) AS BIGINT) AS VARCHAR)), ',')) AS digest
FROM embeddings JOIN walk_out ON vec_id = value""")
def stored_batch(spark, sf):
    """The fourth batch of an epoch, read from a bucketed table."""
    path = scratch_path(spark, "bucketed")
    buckets.publish(reader(spark, sf)("embeddings"), path, 16, "vec_id")
    digits = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("string"))
    return buckets.random_batch(spark, path, 64, 3, seed=7).select("vec_id", "label", F.md5(F.array_join(digits, ",")).alias("digest"))


@query("J2 S6 M1 K2", """
SELECT e.vec_id, lang, label, md5(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 1e6) AS BIGINT) AS VARCHAR)), ',')) AS digest
FROM embeddings e JOIN documents ON doc_id = e.vec_id""")
def bucketed_join(spark, sf):
    """Labels and vectors stored in the same buckets, joined without a shuffle."""
    read = reader(spark, sf)
    stores = {"labels": read("documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vectors": read("embeddings")}
    held = {}
    for name, table in stores.items():
        path = scratch_path(spark, name)
        buckets.publish(table, path, 16, "vec_id")
        held[name] = buckets.read(spark, path)
    digits = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("string"))
    both = buckets.joined(held["labels"], held["vectors"], "vec_id")
    return both.select("vec_id", "lang", "label", F.md5(F.array_join(digits, ",")).alias("digest"))


@query("F6 A1 X6 K1 X1", """
WITH cut AS (SELECT 1 + vec_id % 64 AS n_samples, vec_id % 5 = 0 OR len(list_filter(embedding[1:1 + vec_id % 64], lambda x: x <> 0)) = 0 AS quiet FROM embeddings)
SELECT count(*) AS n, count(*) FILTER (WHERE n_samples >= 16) AS n_kept, count(*) FILTER (WHERE n_samples < 16) AS n_rejected,
       count(*) FILTER (WHERE n_samples >= 16 AND quiet) AS n_silent, count(*) FILTER (WHERE n_samples >= 16) AS n_stored FROM cut""")
def published_counts(spark, sf):
    """Signals of one sample and more, some muted, published without those under a second; counted as they are written."""
    cut = F.slice("embedding", F.lit(1), (F.lit(1) + F.col("vec_id") % 64).cast("int"))
    muted = F.when(F.col("vec_id") % 5 == 0, F.transform(cut, lambda x: F.lit(0.0).cast("float"))).otherwise(cut)
    rows = reader(spark, sf)("embeddings").select(F.col("vec_id").alias("row_id"), muted.alias("samples"))
    rows = rows.withColumn("is_silent", signal.is_silent(F.col("samples")))
    path = scratch_path(spark, "signals")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        counts = publishing.publish_dataset(rows, path, publishing.long_enough(F.size("samples"), 16, 1.0))
    stored = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_stored"))
    return stored.select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], "n_stored")


# Texts of a configuration, there unless the order's key, or there if its customer's key, is divisible by the number.
_USUAL = [
    (2, ', "dataset": "chords"'), (3, ', "dataset_embeddings_label_column_name": "chord_type"'), (5, ', "model_hash": "abc"'),
    (7, ', "num_outputs": 4'),
]
_SPECIAL = [(4, ', "early_stopping": false'), (3, ', "max_num_epochs": 0'), (7, ', "dropout": 0.5')]
_CONFIG = " || ".join([
    """'{"seed": ' || o_orderkey""",
    *[f"CASE WHEN o_orderkey % {n} <> 0 THEN '{text}' ELSE '' END" for n, text in _USUAL],
    *[f"CASE WHEN o_custkey % {n} = 0 THEN '{text}' ELSE '' END" for n, text in _SPECIAL], "'}'",
])


@query("E7", f"""
WITH written AS (SELECT o_orderkey, {_CONFIG} AS config FROM orders),
keyed AS (SELECT o_orderkey, config, json_keys(config) AS names FROM written)
SELECT o_orderkey, array_to_string(
    list_transform(list_filter({lit(list(fv.PROBE_REQUIRED))}, lambda x: NOT list_contains(names, x)), lambda x: x || ' is required')
    || list_transform(list_filter(names, lambda x: NOT list_contains({lit(list(fv.PROBE_DEFAULTS))}, x)), lambda x: x || ' is no parameter of a probe')
    || CASE WHEN config LIKE '%"early_stopping": false%' THEN ['one of early_stopping and max_num_epochs must end the training'] ELSE [] END, '; ') AS faults
FROM keyed""")
def faulty_configs(spark, sf):
    """What is wrong with stored configurations of probes, one per order."""
    config = F.concat(
        F.lit('{"seed": '), F.col("o_orderkey").cast("string"),
        *[F.when(F.col("o_orderkey") % n != 0, text).otherwise("") for n, text in _USUAL],
        *[F.when(F.col("o_custkey") % n == 0, text).otherwise("") for n, text in _SPECIAL], F.lit("}"),
    )
    rows = reader(spark, sf)("orders").select("o_orderkey", config.alias("config"))
    return rows.select("o_orderkey", F.array_join(config_faults(F.col("config")), "; ").alias("faults"))

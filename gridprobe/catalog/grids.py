"""Label tables and parameter grids, decoded from the ids of given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridprobe.catalog.registry import CLICKS, PITCHED, SHARPS, csv, lit, nth, query, reader, values
from gridprobe.functions import dims, hashing, pitch
from gridprobe.functions import fixed_values as fv
from gridprobe.operators import grid, guards, instruments, labels, sweeps
from gridprobe.plans import datasets as ds
from gridprobe.sources import configs

LINE_SQL = "CAST(l_orderkey * 7 + l_linenumber AS BIGINT)"
SOUND = lit(fv.SOUNDFONT)
N = len(dims.pitched_instrument_rows())


def order_ids(spark, sf):
    return reader(spark, sf)("orders").select(F.col("o_orderkey").alias("row_id"))


def line_ids(spark, sf):
    return reader(spark, sf)("lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("row_id"))


def part_ids(spark, sf):
    return reader(spark, sf)("part").select(F.col("p_partkey").alias("row_id"))


def customer_ids(spark, sf):
    return reader(spark, sf)("customer").select(F.col("c_custkey").alias("row_id"))


def _labels_only(df):
    """The label table without the columns a waveform would fill."""
    return df.drop("is_silent", "offset_time")


INST_COLUMNS = "program AS midi_program_num, name AS midi_program_name, category AS midi_category"


def _files(stem: str) -> str:
    return f"{stem} || '.mid' AS midi_file_path, {stem} || '.wav' AS synth_file_path, {SOUND} AS synth_soundfont"


TAIL = "program || '_' || replace(name, ' ', '_')"


@query("G1 G3 P14 J1", f"""
WITH {PITCHED}, ids AS (SELECT o_orderkey AS row_id, CAST(o_orderkey // {N} % 108 AS INT) AS note, CAST(o_orderkey % {N} AS INT) AS i FROM orders),
named AS (SELECT *, ({SHARPS})[note % 12 + 1] AS nm, note // 12 AS oct,
          CASE WHEN note // 12 < 3 THEN 0 WHEN note // 12 < 6 THEN 1 WHEN note // 12 < 9 THEN 2 ELSE 3 END AS reg FROM ids)
SELECT row_id, nm AS root_note_name, note % 12 AS root_note_pitch_class, oct AS octave, nm LIKE '%#' AS root_note_is_accidental,
       reg AS register, note AS midi_note_val, {INST_COLUMNS}, {_files(f"note || '_' || reg || '_' || nm || '_' || {TAIL}")}
FROM named JOIN pitched ON inst_ord = i""")
def note_labels(spark, sf):
    return _labels_only(ds.notes(order_ids(spark, sf)))


@query("G1 G4 P14 J1", f"""
WITH {PITCHED}, ids AS (
  SELECT {LINE_SQL} AS row_id, {LINE_SQL} // {3 * N} % 144 AS p, {LINE_SQL} // {N} % 3 AS s, {LINE_SQL} % {N} AS i FROM lineitem),
named AS (SELECT *, CAST(60 + p // 12 AS INT) AS base, CAST(1 + p % 12 AS INT) AS size, {nth(fv.INTERVAL_STYLES, 's')} AS style FROM ids),
spelled AS (SELECT *, ({SHARPS})[base % 12 + 1] AS nm FROM named)
SELECT row_id, nm AS root_note_name, base % 12 AS root_note_pitch_class, size AS interval, CAST(s AS INT) AS play_style,
       style AS play_style_name, base AS midi_note_val, {INST_COLUMNS},
       {_files(f"nm || '_' || size || '_' || style || '_' || {TAIL}")}
FROM spelled JOIN pitched ON inst_ord = i""")
def interval_labels(spark, sf):
    return _labels_only(ds.intervals(line_ids(spark, sf)))


@query("G1 G5 P14 J1", f"""
WITH {PITCHED}, ids AS (
  SELECT o_orderkey AS row_id, o_orderkey // {2 * N} % 84 AS p, o_orderkey // {N} % 2 AS s, o_orderkey % {N} AS i FROM orders),
named AS (SELECT *, ({SHARPS})[p // 7 + 1] AS nm, {nth(fv.SCALE_MODES, 'p % 7')} AS mode, {nth(fv.SCALE_STYLES, 's')} AS style FROM ids)
SELECT row_id, nm AS root_note_name, mode, CAST(s AS INT) AS play_style, style AS play_style_name, {INST_COLUMNS},
       {_files(f"nm || '_' || mode || '_' || style || '_' || {TAIL}")}
FROM named JOIN pitched ON inst_ord = i""")
def scale_labels(spark, sf):
    return _labels_only(ds.scales(order_ids(spark, sf)))


@query("G1 G6 P14 J1", f"""
WITH {PITCHED}, ids AS (
  SELECT o_orderkey AS row_id, o_orderkey // {3 * N} % 48 AS p, o_orderkey // {N} % 3 AS v, o_orderkey % {N} AS i FROM orders),
named AS (SELECT *, CAST(p // 4 AS INT) AS pc, {nth(fv.CHORD_KINDS, 'p % 4')} AS kind, coalesce({nth(fv.INVERSIONS, 'v')}, '5') AS inv FROM ids),
spelled AS (SELECT *, ({SHARPS})[pc + 1] AS nm FROM named)
SELECT row_id, nm AS root_note_name, kind AS chord_type, inv AS inversion, nm LIKE '%#' AS root_note_is_accidental,
       pc AS root_note_pitch_class, {INST_COLUMNS}, {_files(f"nm || '_' || kind || '_' || inv || '_' || {TAIL}")}
FROM spelled JOIN pitched ON inst_ord = i""")
def chord_labels(spark, sf):
    return _labels_only(ds.chords(order_ids(spark, sf)))


PROGS = values("progs", "prog_ord, mode, degs", [(i, m, d) for i, (m, d) in enumerate(fv.PROGRESSIONS)])


@query("G1 G7 P14 J1", f"""
WITH {PITCHED}, {PROGS}, ids AS (
  SELECT {LINE_SQL} AS row_id, {LINE_SQL} // {19 * N} % 12 AS k, {LINE_SQL} // {N} % 19 AS p, {LINE_SQL} % {N} AS i FROM lineitem),
named AS (SELECT *, ({SHARPS})[k + 1] AS nm FROM ids JOIN progs ON prog_ord = p)
SELECT row_id, nm AS key_note_name, CAST(k AS INT) AS key_note_pitch_class,
       mode || '-(' || array_to_string(degs, ', ') || ')' AS chord_progression, {INST_COLUMNS},
       {_files(f"nm || '_' || mode || '_' || array_to_string(degs, '-') || '_' || {TAIL}")}
FROM named JOIN pitched ON inst_ord = i""")
def progression_labels(spark, sf):
    return _labels_only(ds.progressions(line_ids(spark, sf)))


@query("G2 G10 G11 P14", f"""
WITH {CLICKS}, ids AS (
  SELECT p_partkey AS base, CAST(50 + p_partkey // 5 % 161 AS INT) AS bpm, p_partkey % 5 AS c, o FROM part, range(5) r(o)),
named AS (SELECT *, bpm || '_bpm_' || name AS stem FROM ids JOIN clicks ON click_ord = c)
SELECT base * 5 + o AS row_id, bpm, name AS click_config_name, program AS midi_program_num, stem || '.mid' AS midi_file_path,
       stem || '.wav' AS synth_file_path, stem || '_offset_' || o || '.wav' AS offset_file_path, {SOUND} AS synth_soundfont
FROM named""")
def tempo_labels(spark, sf):
    return _labels_only(ds.tempos(part_ids(spark, sf)))


@query("G2 G12 P14 P15", f"""
WITH {CLICKS}, ids AS (
  SELECT c_custkey AS base, c_custkey // 15 % 8 AS s, CAST(c_custkey // 5 % 3 AS INT) AS level, c_custkey % 5 AS c, o FROM customer, range(10) r(o)),
metered AS (SELECT *, {nth([m[0] for m in fv.TIME_SIGNATURES], 's')} AS beats, {nth([m[1] for m in fv.TIME_SIGNATURES], 's')} AS division FROM ids),
named AS (SELECT *, beats || '_' || division || '_120_bpm_' || name || '_reverb_level_' || level AS stem FROM metered JOIN clicks ON click_ord = c)
SELECT base * 10 + o AS row_id, '(' || beats || ', ' || division || ')' AS time_signature, beats AS time_signature_beats,
       division AS time_signature_subdivision, CAST(beats % 3 = 0 AND division <> 4 AS INT) AS is_compound, 120 AS bpm,
       name AS click_config_name, program AS midi_program_num, stem || '.mid' AS midi_file_path, stem || '.wav' AS synth_file_path,
       stem || '_offset_' || o || '.wav' AS offset_file_path, {SOUND} AS synth_soundfont, level AS reverb_level
FROM named""")
def time_signature_labels(spark, sf):
    return _labels_only(ds.time_signatures(customer_ids(spark, sf)))


@query("G1 G3", f"""
WITH ids AS (SELECT CAST(o_orderkey // {N} % 108 AS INT) AS note FROM orders)
SELECT ({SHARPS})[note % 12 + 1] AS root_note_name,
       CASE WHEN note // 12 < 3 THEN 0 WHEN note // 12 < 6 THEN 1 WHEN note // 12 < 9 THEN 2 ELSE 3 END AS register, count(*) AS n
FROM ids GROUP BY ALL""")
def notes_per_register(spark, sf):
    return ds.notes(order_ids(spark, sf)).groupBy("root_note_name", "register").agg(F.count("*").alias("n"))


MODELS = list(fv.MODEL_LAYERS)


@query("G8 J1 S7", f"""
WITH concepts AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS c FROM (SELECT DISTINCT source FROM documents)),
models AS (SELECT unnest({lit(MODELS)}) AS model_name, unnest(range(9)) AS m)
SELECT c * 9 + row_number() OVER (PARTITION BY source ORDER BY model_name) - 1 AS run_id, source AS concept, model_name,
       model_name <> 'JUKEBOX' AS decoder_hidden_states
FROM concepts, models""")
def run_grid(spark, sf):
    concepts = labels.domain(reader(spark, sf)("documents"), "source").withColumnRenamed("source", "concept")
    models = dims.models(spark).select("model_name")
    runs = grid.dense_grid(spark, [(concepts, ["concept"]), (models, ["model_name"])], "run_id")
    return runs.withColumn("decoder_hidden_states", configs.decoder_hidden_states(F.col("model_name")))


SPACES = {name: sweeps.sweep_space(name) for name in fv.SWEEP_SPACES}


def _sweep_sql(name: str, table: str, key: str) -> str:
    columns, stride = [], 1
    for parameter, entries in reversed(SPACES[name].items()):
        ordinal = f"{key} // {stride} % {len(entries)}"
        if isinstance(entries[0], tuple):
            text = [",".join(map(str, e)) for e in entries]
            columns.append(f"{nth(text, ordinal)} AS {parameter}")
        elif parameter == "l2_weight_decay":
            columns.append(f"CAST(coalesce({nth(entries, ordinal)}, 0) AS DOUBLE) AS {parameter}")
        else:
            columns.append(f"{nth(entries, ordinal)} AS {parameter}")
        stride *= len(entries)
    return f"SELECT {key} AS config_id, {', '.join(reversed(columns))} FROM {table}"


def _sweep_rows(spark, sf, name, table, key):
    ids = reader(spark, sf)(table).select(F.col(key).alias("config_id"))
    df = sweeps.expand_space(ids, SPACES[name])
    if "hidden_layer_sizes" in df.columns:
        df = df.withColumns({
            "hidden_layer_sizes": csv(F.col("hidden_layer_sizes")),
            "l2_weight_decay": F.coalesce("l2_weight_decay", F.lit(0.0)),
        })
    return df


@query("G9", _sweep_sql("handcrafted", "orders", "o_orderkey"))
def sweep_handcrafted(spark, sf):
    return _sweep_rows(spark, sf, "handcrafted", "orders", "o_orderkey")


@query("G9", _sweep_sql("encoder", "part", "p_partkey"))
def sweep_encoder(spark, sf):
    return _sweep_rows(spark, sf, "encoder", "part", "p_partkey")


@query("G9", _sweep_sql("jukebox", "part", "p_partkey"))
def sweep_jukebox(spark, sf):
    return _sweep_rows(spark, sf, "jukebox", "part", "p_partkey")


@query("G9", _sweep_sql("musicgen", "orders", "o_orderkey"))
def sweep_musicgen(spark, sf):
    return _sweep_rows(spark, sf, "musicgen", "orders", "o_orderkey")


@query("G10", """
WITH spans AS (SELECT 50 + c_custkey % 40 AS low, 50 + c_custkey % 40 + c_nationkey AS high FROM customer),
bpms AS (SELECT CAST(unnest(range(low, high + 1)) AS INT) AS bpm FROM spans)
SELECT bpm, count(*) AS n FROM bpms GROUP BY bpm""")
def bpm_domain(spark, sf):
    low = (F.col("c_custkey") % 40 + 50).cast("int")
    spans = reader(spark, sf)("customer").select(F.explode(F.sequence(low, low + F.col("c_nationkey"))).alias("bpm"))
    return spans.groupBy("bpm").agg(F.count("*").alias("n"))


@query("G11 G12", f"""
WITH keyed AS (SELECT CAST(50 + p_partkey % 161 AS INT) AS bpm, {nth([m[1] for m in fv.TIME_SIGNATURES], 'p_partkey % 8')} AS division FROM part)
SELECT bpm, division, bpm // 3 AS tempo_beats, CAST(floor(division / 4.0 * (bpm // 2)) AS INT) AS signature_beats, count(*) AS n
FROM keyed GROUP BY ALL""")
def click_plans(spark, sf):
    df = reader(spark, sf)("part").select(
        (F.col("p_partkey") % 161 + 50).cast("int").alias("bpm"),
        dims.pick([m[1] for m in fv.TIME_SIGNATURES], F.col("p_partkey") % 8).alias("division"),
    )
    bpm, division = F.col("bpm"), F.col("division")
    return df.groupBy(
        "bpm", "division", pitch.tempo_beats(bpm).alias("tempo_beats"),
        pitch.signature_beats(division, bpm).alias("signature_beats"),
    ).agg(F.count("*").alias("n"))


@query("E5 U2", """
SELECT lang, count(*) AS n, count(DISTINCT md5(text)) AS n_distinct, count(*) = count(DISTINCT md5(text)) AS is_unique
FROM documents GROUP BY lang""")
def text_uniqueness(spark, sf):
    docs = reader(spark, sf)("documents").select("lang", hashing.checksum(F.col("text"), "md5").alias("digest"))
    return guards.uniqueness(docs, "digest", "lang")


FACT_INSTRUMENTS = values("instruments", "category, program, name", dims.instrument_rows())
EXCLUDED = lit(fv.POLYPHONIC_PROGRAMS + fv.ARTICULATE_PROGRAMS)


def line_instruments(spark, sf):
    t = reader(spark, sf)("lineitem").select((F.col("l_partkey") % 128).cast("int").alias("program"), "l_quantity")
    return t.join(F.broadcast(dims.instruments(spark)), "program")


@query("S1 F1 F2 F3 J3", f"""
WITH {FACT_INSTRUMENTS}
SELECT category, name, count(*) AS n FROM lineitem JOIN instruments ON program = l_partkey % 128
WHERE category NOT IN ('Synth Effects', 'Sound Effects') AND NOT list_contains({EXCLUDED}, program) GROUP BY ALL""")
def pitched_instruments_played(spark, sf):
    kept = instruments.select_instruments(line_instruments(spark, sf), True, True, True)
    return kept.groupBy("category", "name").agg(F.count("*").alias("n"))


@query("F1", f"""
WITH {FACT_INSTRUMENTS}
SELECT category, count(*) AS n FROM lineitem JOIN instruments ON program = l_partkey % 128
WHERE category NOT IN ('Synth Effects', 'Sound Effects') GROUP BY ALL""")
def tonal_categories(spark, sf):
    kept = instruments.select_instruments(line_instruments(spark, sf), ignore_atonal=True)
    return kept.groupBy("category").agg(F.count("*").alias("n"))


@query("F2 F3 U3", f"""
SELECT CAST(l_partkey % 128 AS INT) AS program, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem
WHERE NOT list_contains({EXCLUDED}, l_partkey % 128) GROUP BY ALL""")
def excluded_programs_anti_join(spark, sf):
    kept = instruments.drop_excluded(line_instruments(spark, sf))
    return kept.groupBy("program").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("W2", """
WITH filtered AS (SELECT p_partkey AS program, p_type AS category FROM part WHERE p_type NOT IN ('Synth Effects', 'Sound Effects')
                  AND p_partkey NOT IN (8, 9, 14, 21, 23, 47, 86)),
placed AS (SELECT *, lag(category) OVER (ORDER BY program) AS prev FROM filtered)
SELECT program, category FROM placed WHERE prev IS NULL OR prev <> category""")
def first_of_each_category(spark, sf):
    parts = reader(spark, sf)("part").select(F.col("p_partkey").alias("program"), F.col("p_type").alias("category"))
    return instruments.select_instruments(parts, True, True, False, take_only_first_category=True)

"""Scales, chords and progressions, driven by ids of the fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridprobe.catalog.registry import (
    MODE_NAMES, MODES, SHARPS, csv, lit, nth, query, reader, tonic_sql, values,
)
from gridprobe.functions import dims, hashing, naming, pitch
from gridprobe.functions import fixed_values as fv
from gridprobe.operators import registry as exports
from gridprobe.operators import shards, theory
from gridprobe.plans.custom_dataset import process_rows_sql, table_function
from gridprobe.sources import tables

FLATS = ["C", "Db", "D", "Eb", "E", "E#", "Gb", "G", "Ab", "A", "Bb", "B"]
ACCIDENTALS = ["", "b", "#", "bb", "##"]
TYPES = [5, 7, 9, 11, 13]
EXTENSIONS = [[], [9], [9, 11], [13]]
BORROWED = [None, "aeolian", "dorian"]
METERS = fv.TIME_SIGNATURES
MODELS = list(fv.MODEL_LAYERS)


def keyed_lineitem(spark, sf):
    """lineitem with musical coordinates derived from its keys."""
    t = reader(spark, sf)("lineitem")
    return t.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_partkey") % 12).cast("int").alias("root"),
        dims.pick(MODE_NAMES, F.col("l_suppkey") % 11).alias("mode"),
        (F.col("l_orderkey") % 7 + 1).cast("int").alias("degree"),
        dims.pick(TYPES, F.col("l_linenumber") % 5).alias("chord_type"),
        dims.pick(fv.INVERSIONS, F.col("l_quantity").cast("int") % 3).alias("inversion"),
    )


KEYED_SQL = f"""keyed AS (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey % 12 AS INT) AS root, mode, offs,
         CAST(l_orderkey % 7 + 1 AS INT) AS degree, {nth(TYPES, 'l_linenumber % 5')} AS chord_type,
         {nth(fv.INVERSIONS, 'CAST(l_quantity AS INT) % 3')} AS inversion
  FROM lineitem JOIN modes ON mode_ord = l_suppkey % 11)"""

# Chord size, stacked pitch classes and notes of root-position chords.
STACKED_SQL = f"""sized AS (
  SELECT *, CASE chord_type WHEN 5 THEN 3 WHEN 7 THEN 4 WHEN 9 THEN 5 ELSE 6 END AS size FROM keyed),
stacked AS (
  SELECT *, [(root + offs[(degree - 1 + 2 * i) % 7 + 1]) % 12 for i in range(size)] AS pcs,
         [{tonic_sql('root')} + offs[(degree - 1 + 2 * i) % 7 + 1] for i in range(size)] AS notes
  FROM sized),
named AS (
  SELECT *, CASE ((pcs[2] - pcs[1] + 12) % 12, (pcs[3] - pcs[1] + 12) % 12)
              WHEN (4, 7) THEN 'Maj' WHEN (3, 7) THEN 'm' WHEN (3, 6) THEN 'd' WHEN (4, 8) THEN 'A' END AS quality,
         CASE chord_type WHEN 5 THEN '' ELSE CAST(chord_type AS VARCHAR) END AS suffix
  FROM stacked),
turned AS (
  SELECT *, CASE inversion WHEN '6' THEN pcs[2:] || pcs[1:1] WHEN '64' THEN pcs[3:] || pcs[1:2] ELSE pcs END AS pcs_t,
         CASE inversion WHEN '6' THEN notes[2:] || [n + 12 for n in notes[1:1]]
              WHEN '64' THEN notes[3:] || [n + 12 for n in notes[1:2]] ELSE notes END AS notes_t
  FROM named)"""


@query("P1 J3", f"""
SELECT p_partkey, ({SHARPS})[p_partkey % 12 + 1] AS sharp,
       {nth(['/'.join(n) for n in fv.ENHARMONIC_NAMES], 'p_partkey % 12')} AS spellings,
       {nth(FLATS, 'p_partkey % 12')} AS flat,
       CAST(p_partkey % 12 AS INT) AS pitch_class
FROM part""")
def pitch_names(spark, sf):
    pc = (F.col("p_partkey") % 12).cast("int")
    flat = dims.pick(FLATS, pc)
    return reader(spark, sf)("part").select(
        "p_partkey",
        pitch.sharp_name(pc).alias("sharp"),
        F.array_join(pitch.spellings(pc), "/").alias("spellings"),
        flat.alias("flat"),
        pitch.pitch_class_of(flat).alias("pitch_class"),
    )


@query("P2 P3", f"""
WITH {MODES}, {KEYED_SQL}
SELECT root, mode, array_to_string([(root + o) % 12 for o in offs], ',') AS scale, count(*) AS n
FROM keyed GROUP BY ALL""")
def scale_pitch_classes(spark, sf):
    df = keyed_lineitem(spark, sf)
    scale = pitch.scale_of(F.col("root"), pitch.mode_offsets(F.col("mode")))
    return df.groupBy("root", "mode", csv(scale).alias("scale")).agg(F.count("*").alias("n"))


@query("P2 J3", f"""
WITH {MODES}
SELECT l_orderkey, l_linenumber, mode, CAST(list_sum(offs) AS BIGINT) AS offset_sum
FROM lineitem JOIN modes ON mode_ord = l_suppkey % 11""")
def mode_dictionary_lookup(spark, sf):
    t = reader(spark, sf)("lineitem")
    keyed = t.select("l_orderkey", "l_linenumber", dims.pick(MODE_NAMES, F.col("l_suppkey") % 11).alias("mode"))
    joined = keyed.join(F.broadcast(dims.modes(spark)), "mode")
    total = F.aggregate("offsets", F.lit(0).cast("bigint"), lambda a, o: a + o)
    return joined.select("l_orderkey", "l_linenumber", "mode", total.alias("offset_sum"))


@query("P4", f"""
SELECT CAST(l_partkey % 12 AS INT) AS pitch_class, CAST({tonic_sql('l_partkey % 12')} AS INT) AS tonic, count(*) AS n
FROM lineitem GROUP BY ALL""")
def tonic_placement(spark, sf):
    df = keyed_lineitem(spark, sf).withColumn("tonic", pitch.tonic_note(F.col("root")))
    return df.groupBy(F.col("root").alias("pitch_class"), "tonic").agg(F.count("*").alias("n"))


@query("P5", f"""
WITH {MODES}, {KEYED_SQL}, marked AS (
  SELECT *, {nth(ACCIDENTALS, 'l_orderkey % 5')} AS mark, CAST(l_linenumber % 3 - 1 AS INT) AS octave FROM keyed),
shifted AS (SELECT *, CASE WHEN mark = '' THEN 0 WHEN mark[1] = 'b' THEN -1 ELSE 1 END AS shift FROM marked)
SELECT root, mode, mark || degree AS degree, octave,
       CAST((root + offs[degree]) % 12 + shift AS INT) AS pitch_class,
       CAST({tonic_sql('root')} + offs[degree] + shift + octave * 12 AS INT) AS note, count(*) AS n
FROM shifted GROUP BY ALL""")
def scale_degree_notes(spark, sf):
    df = keyed_lineitem(spark, sf)
    mark = dims.pick(ACCIDENTALS, F.col("l_orderkey") % 5)
    df = df.withColumns({
        "degree": F.concat(mark, F.col("degree").cast("string")),
        "octave": (F.col("l_linenumber") % 3 - 1).cast("int"),
        "offsets": pitch.mode_offsets(F.col("mode")),
    })
    df = df.withColumn("scale", pitch.scale_of(F.col("root"), F.col("offsets")))
    found = pitch.degree_pitch(F.col("scale"), F.col("offsets"), F.col("degree"), F.col("octave"))
    return df.withColumn("p", found).groupBy(
        "root", "mode", "degree", "octave", F.col("p.pitch_class").alias("pitch_class"), F.col("p.note").alias("note")
    ).agg(F.count("*").alias("n"))


@query("P6 P7 P10", f"""
WITH {MODES}, {KEYED_SQL}, {STACKED_SQL}
SELECT l_orderkey, l_linenumber, array_to_string(pcs, ',') AS pitch_classes, array_to_string(notes, ',') AS notes,
       ({SHARPS})[pcs[1] + 1] || quality || suffix || '[]' AS name
FROM named""")
def diatonic_chords(spark, sf):
    df = theory.join_chord(keyed_lineitem(spark, sf), "root", "mode", "degree", "chord_type")
    return df.select(
        "l_orderkey", "l_linenumber", csv(F.col("chord.pitch_classes")).alias("pitch_classes"),
        csv(F.col("chord.notes")).alias("notes"), F.col("chord.name").alias("name"),
    )


@query("P8 P10", f"""
WITH {MODES}, {KEYED_SQL}, {STACKED_SQL}
SELECT root, mode, degree, chord_type, coalesce(inversion, '5') AS inversion, array_to_string(notes_t, ',') AS notes,
       ({SHARPS})[pcs_t[1] + 1] || quality || suffix || coalesce(inversion, '') || '[]' AS name, count(*) AS n
FROM turned GROUP BY ALL""")
def chord_inversions(spark, sf):
    df = theory.join_chord(keyed_lineitem(spark, sf), "root", "mode", "degree", "chord_type", "inversion")
    return df.groupBy(
        "root", "mode", "degree", "chord_type", F.coalesce("inversion", F.lit("5")).alias("inversion"),
        csv(F.col("chord.notes")).alias("notes"), F.col("chord.name").alias("name"),
    ).agg(F.count("*").alias("n"))


@query("P9 P10", f"""
WITH {MODES}, based AS (
  SELECT CAST(o_custkey % 12 AS INT) AS root, CAST(o_orderkey % 7 + 1 AS INT) AS degree,
         {nth(EXTENSIONS, 'o_orderkey % 4')} AS ext, {nth(BORROWED, 'o_orderkey % 3')} AS borrowed FROM orders),
keyed AS (
  SELECT b.*, m.offs FROM based b JOIN modes m ON m.mode = coalesce(b.borrowed, 'ionian')),
stacked AS (
  SELECT *, [(root + offs[(degree - 1 + 2 * i) % 7 + 1]) % 12 for i in range(3)] AS pcs,
         [{tonic_sql('root')} + offs[(degree - 1 + 2 * i) % 7 + 1] for i in range(3)] AS base,
         [{tonic_sql('root')} + 12 + offs[e % 7 + 1] for e in ext] AS added,
         [(root + offs[e % 7 + 1]) % 12 for e in ext] AS added_pcs FROM keyed)
SELECT root, degree, array_to_string(ext, ',') AS extensions, coalesce(borrowed, 'none') AS borrowed,
       array_to_string(base || added, ',') AS notes, array_to_string(pcs || added_pcs, ',') AS pitch_classes,
       ({SHARPS})[pcs[1] + 1] || CASE ((pcs[2] - pcs[1] + 12) % 12, (pcs[3] - pcs[1] + 12) % 12)
         WHEN (4, 7) THEN 'Maj' WHEN (3, 7) THEN 'm' WHEN (3, 6) THEN 'd' ELSE 'A' END
       || '[' || CASE WHEN len(ext) > 0 THEN 'add' || array_to_string(ext, '') ELSE '' END
       || CASE WHEN borrowed IS NULL THEN '' ELSE ' (' || borrowed || ')' END || ']' AS name, count(*) AS n
FROM stacked GROUP BY ALL""")
def chord_extensions_and_borrowing(spark, sf):
    orders = reader(spark, sf)("orders")
    df = orders.select(
        (F.col("o_custkey") % 12).cast("int").alias("root"),
        F.lit("ionian").alias("mode"),
        (F.col("o_orderkey") % 7 + 1).cast("int").alias("degree"),
        F.lit(5).alias("chord_type"),
        dims.pick(EXTENSIONS, F.col("o_orderkey") % 4).cast("array<int>").alias("ext"),
        dims.pick(BORROWED, F.col("o_orderkey") % 3).alias("lent"),
    )
    df = theory.add_chord(df, "root", "mode", "degree", "chord_type", extensions="ext", borrowed="lent")
    return df.groupBy(
        "root", "degree", csv(F.col("ext")).alias("extensions"), F.coalesce("lent", F.lit("none")).alias("borrowed"),
        csv(F.col("chord.notes")).alias("notes"), csv(F.col("chord.pitch_classes")).alias("pitch_classes"),
        F.col("chord.name").alias("name"),
    ).agg(F.count("*").alias("n"))


RECIPES = values("recipes", "kind, mode_name, deg, size, shift, quality, suffix", [
    (k, m, d, 4 if t == 7 else 3, s, q, "7" if t == 7 else "")
    for (k, m, d, t, s), q in zip(fv.CHORD_RECIPES, ("Maj", "m", "A", "d", "Maj"))
])
KINDS = [r[0] for r in fv.CHORD_RECIPES]


@query("P11 P12 J3", f"""
WITH {MODES}, {RECIPES}, keyed AS (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey % 12 AS INT) AS pc, {nth(KINDS, 'l_suppkey % 5')} AS kind FROM lineitem),
joined AS (
  SELECT k.*, r.quality, r.suffix, r.size, r.deg, (k.pc + r.shift + 12) % 12 AS home, m.offs
  FROM keyed k JOIN recipes r USING (kind) JOIN modes m ON m.mode = r.mode_name),
built AS (
  SELECT *, [{tonic_sql('home')} + offs[(deg - 1 + 2 * i) % 7 + 1] for i in range(size)] AS notes FROM joined)
SELECT l_orderkey, l_linenumber, kind, array_to_string(notes, ',') AS notes,
       array_to_string([notes[1] - 12] || notes, ',') AS voiced,
       ({SHARPS})[(home + offs[deg]) % 12 + 1] || quality || suffix || '[]' AS name
FROM built""")
def named_chords(spark, sf):
    df = reader(spark, sf)("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 12).cast("int").alias("pc"),
        dims.pick(KINDS, F.col("l_suppkey") % 5).alias("kind"),
    )
    df = theory.join_named_chord(df, "pc", "kind")
    return df.select(
        "l_orderkey", "l_linenumber", "kind", csv(F.col("chord.notes")).alias("notes"),
        csv(theory.bass_doubled(F.col("chord.notes"))).alias("voiced"), F.col("chord.name").alias("name"),
    )


PROGS = values("progs", "prog_ord, prog_mode, degs", [(i, m, d) for i, (m, d) in enumerate(fv.PROGRESSIONS)])


@query("P13", f"""
WITH {MODES}, {PROGS}, keyed AS (
  SELECT CAST(o_custkey % 12 AS INT) AS key, prog_mode AS mode, degs, offs
  FROM orders JOIN progs ON prog_ord = o_orderkey % 19 JOIN modes ON mode = prog_mode)
SELECT key, mode, array_to_string(degs, '-') AS degrees,
       array_to_string([array_to_string([{tonic_sql('key')} + offs[(d - 1 + 2 * i) % 7 + 1] for i in range(3)], ',')
                        for d in degs], '|') AS chords, count(*) AS n
FROM keyed GROUP BY ALL""")
def progression_chords(spark, sf):
    orders = reader(spark, sf)("orders")
    df = orders.select(
        (F.col("o_custkey") % 12).cast("int").alias("key"),
        dims.pick_record(fv.PROGRESSIONS, ("mode", "degrees"), F.col("o_orderkey") % 19).alias("p"),
    ).select("key", "p.mode", F.col("p.degrees").alias("degs"))
    built = theory.progression_chords(F.col("key"), pitch.mode_offsets(F.col("mode")), F.col("degs"))
    text = F.array_join(F.transform(built, lambda c: csv(c)), "|")
    return df.groupBy("key", "mode", naming.dashed(F.col("degs")).alias("degrees"), text.alias("chords")).agg(
        F.count("*").alias("n")
    )


@query("P15 P16 P17", f"""
WITH keyed AS (
  SELECT {nth([m[0] for m in METERS], 'l_orderkey % 8')} AS beats, {nth([m[1] for m in METERS], 'l_orderkey % 8')} AS division,
         CAST(50 + l_partkey % 161 AS INT) AS bpm, CAST(l_linenumber % 3 AS INT) AS level FROM lineitem)
SELECT beats, division, beats % 3 = 0 AND division <> 4 AS is_compound, bpm,
       CAST(round_even(60000000.0 / bpm, 0) AS INT) AS tempo, level, {nth([0, 63, 127], 'level')} AS reverb, count(*) AS n
FROM keyed GROUP BY ALL""")
def meter_tempo_reverb(spark, sf):
    t = reader(spark, sf)("lineitem")
    df = t.select(
        dims.pick([m[0] for m in METERS], F.col("l_orderkey") % 8).alias("beats"),
        dims.pick([m[1] for m in METERS], F.col("l_orderkey") % 8).alias("division"),
        (F.col("l_partkey") % 161 + 50).cast("int").alias("bpm"),
        (F.col("l_linenumber") % 3).cast("int").alias("level"),
    )
    return df.groupBy(
        "beats", "division", pitch.is_compound(F.col("beats"), F.col("division")).alias("is_compound"), "bpm",
        pitch.quarter_micros(F.col("bpm")).alias("tempo"), "level", pitch.reverb_value(F.col("level")).alias("reverb"),
    ).agg(F.count("*").alias("n"))


@query("P18", """
SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN source || '_offset.wav' ELSE '' END, ''), source || '.wav') AS audio_file_path
FROM documents""")
def audio_path_choice(spark, sf):
    docs = reader(spark, sf)("documents")
    df = docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.concat("source", F.lit("_offset.wav"))).otherwise("").alias("offset_file_path"),
        F.concat("source", F.lit(".wav")).alias("synth_file_path"),
    )
    return tables.audio_paths(df).select("doc_id", "audio_file_path")


@query("P19 P20 P21", f"""
WITH named AS (
  SELECT p_partkey, {nth(MODELS, 'p_partkey % 9')} AS model_name, {nth(list(fv.MODEL_LAYERS.values()), 'p_partkey % 9')} AS max_layers
  FROM part)
SELECT p_partkey, model_name,
       CASE WHEN model_name LIKE 'MUSICGEN_DECODER%' THEN split_part(model_name, '_LM_', 2) ELSE 'L' END AS model_size,
       CASE WHEN model_name LIKE 'MUSICGEN_DECODER%' THEN 'MUSICGEN_DECODER' ELSE model_name END AS model_type,
       CASE WHEN model_name LIKE 'MUSICGEN_DECODER%' THEN split_part(model_name, '_LM', 1) ELSE model_name END AS family,
       coalesce(max_layers, -1) AS max_layers
FROM named""")
def model_label_parsing(spark, sf):
    df = reader(spark, sf)("part").select("p_partkey", dims.pick(MODELS, F.col("p_partkey") % 9).alias("model_name"))
    name = F.col("model_name")
    return df.select(
        "p_partkey", "model_name",
        exports.model_size(name).alias("model_size"),
        exports.model_family(name).alias("model_type"),
        exports.family_key(name).alias("family"),
        F.coalesce(exports.max_layers(name), F.lit(-1)).alias("max_layers"),
    )


@query("P22", """
SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents""")
def text_checksums(spark, sf):
    text = F.col("text")
    return reader(spark, sf)("documents").select(
        "doc_id", *[hashing.checksum(text, a).alias(a) for a in ("sha256", "md5", "sha1")]
    )


@query("P23", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS "props.k" FROM events""")
def flattened_props(spark, sf):
    parsed = reader(spark, sf)("events").withColumn("props", F.from_json("props", "k int"))
    return parsed.select("event_id", "event_type", F.col("props.k").alias("props.k"))


@query("P24", """
SELECT event_id, round(CAST(epoch_us((SELECT max(ts) FROM events)) // 1000000 - epoch_us(ts) // 1000000 AS DOUBLE) / 3600.0, 6) + 0.0 AS hours
FROM events""")
def elapsed_hours(spark, sf):
    events = reader(spark, sf)("events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    now = events.agg(F.max("ts").alias("now")).scalar()
    hours = shards.elapsed_hours(F.col("ts"), now)
    return events.select("event_id", (F.round(hours, 6) + F.lit(0.0)).alias("hours"))


# Progressions of a user's own: a mode the canned ones lack, and sevenths, as (degree, chord type).
OWN_PROGRESSIONS = [
    ("ionian", [(1, 5), (4, 5), (5, 7), (1, 5)]), ("aeolian", [(7, 5), (6, 5), (7, 5), (1, 7)]), ("dorian", [(1, 5), (7, 7), (2, 5), (3, 5)]),
]
_OWN = values("own", "own_ord, own_mode, degs, types", [
    (i, mode, [d for d, _ in steps], [t for _, t in steps]) for i, (mode, steps) in enumerate(OWN_PROGRESSIONS)
])


def _fanned_out():
    """A row processor of a user's own: one row per chord of a progression, with ids that count on through the table."""

    def chord_rows(row, separator=" "):
        row_id, record = row
        steps = record["steps"]
        label = "-".join(str(s["degree"]) if s["chord_type"] == 5 else f"{s['degree']}^{s['chord_type']}" for s in steps)
        return [
            (row_id * len(steps) + k, {
                "key": record["key"], "progression": f"{record['mode']} {label}", "place": k,
                "notes": separator.join(str(n) for n in record["chords"][k]),
            })
            for k in range(len(steps))
        ]

    def columns(given, separator=" "):
        return StructType([given["key"]]).add("progression", "string").add("place", "integer").add("notes", "string")

    return table_function(chord_rows, columns)


@query("P13 G7", f"""
WITH {MODES}, {_OWN}, keyed AS (
  SELECT c_custkey, CAST(c_custkey % 12 AS INT) AS key, own_mode, degs, types, offs
  FROM customer JOIN own ON own_ord = c_custkey // 12 % 3 JOIN modes ON mode = own_mode)
SELECT c_custkey * 4 + c AS row_id, key,
       own_mode || ' ' || array_to_string([degs[j] || CASE WHEN types[j] = 7 THEN '^7' ELSE '' END for j in range(1, 5)], '-') AS progression,
       CAST(c AS INT) AS place,
       array_to_string([{tonic_sql('key')} + offs[(degs[c + 1] - 1 + 2 * i) % 7 + 1] for i in range(CASE WHEN types[c + 1] = 7 THEN 4 ELSE 3 END)], ',') AS notes
FROM keyed, range(4) r(c)""")
def own_progressions(spark, sf):
    """Progressions with sevenths and another mode, fanned out to chords by a user's row processor as a table function."""
    df = reader(spark, sf)("customer").select(
        F.col("c_custkey").alias("row_id"), (F.col("c_custkey") % 12).cast("int").alias("key"),
        dims.pick_record([(m, [d for d, _ in s], [t for _, t in s]) for m, s in OWN_PROGRESSIONS], ("mode", "degrees", "types"),
                         F.floor(F.col("c_custkey") / 12) % 3).alias("own"),
    )
    typed = F.transform(F.arrays_zip("own.degrees", "own.types"), lambda z: F.struct(
        z["degrees"].cast("int").alias("degree"), z["types"].cast("int").alias("chord_type")))
    df = df.select("row_id", "key", F.col("own.mode").alias("mode"), typed.alias("steps"))
    df = df.withColumn("chords", theory.typed_progression_chords(F.col("key"), pitch.mode_offsets(F.col("mode")), F.col("steps")))
    return process_rows_sql(df, _fanned_out(), separator=",")

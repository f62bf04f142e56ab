"""Note events, messages and click tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridprobe.catalog.registry import CLICKS, MODE_NAMES, MODES, csv, nth, query, reader, rounded, tonic_sql
from gridprobe.functions import dims, pitch
from gridprobe.functions import fixed_values as fv
from gridprobe.operators import sequences, theory
from gridprobe.operators.unnest import unnest
from gridprobe.plans.datasets import CLICK_FIELDS

METERS = fv.TIME_SIGNATURES


def _events(df, *keys):
    exploded = sequences.explode_events(df, "events", *keys)
    return exploded.select(*keys, "seq", "start_beat", "end_beat", csv(F.col("notes")).alias("notes"))


@query("V1 W4", """
SELECT p_partkey, CAST(i AS INT) AS seq, CAST(2 * i AS INT) AS start_beat, CAST(2 * i + 2 AS INT) AS end_beat,
       CAST(p_partkey % 108 AS VARCHAR) AS notes
FROM part, range(4) r(i)""")
def repeated_notes(spark, sf):
    df = reader(spark, sf)("part").select("p_partkey", (F.col("p_partkey") % 108).cast("int").alias("note"))
    return _events(df.withColumn("events", sequences.repeated(F.array("note"))), "p_partkey")


@query("V1 P13", f"""
WITH {MODES}, keyed AS (
  SELECT c_custkey, CAST(c_nationkey % 12 AS INT) AS root, offs, [1, c_custkey % 7 + 1, 5] AS degs
  FROM customer JOIN modes ON mode_ord = c_custkey % 11),
chords AS (
  SELECT c_custkey, c, [{tonic_sql('root')} + offs[(degs[c + 1] - 1 + 2 * i) % 7 + 1] for i in range(3)] AS notes
  FROM keyed, range(3) r(c))
SELECT c_custkey, CAST(c * 2 + p AS INT) AS seq, CAST((c * 2 + p) * 2 AS INT) AS start_beat,
       CAST((c * 2 + p) * 2 + 2 AS INT) AS end_beat, array_to_string(notes, ',') AS notes
FROM chords, range(2) q(p)""")
def chained_chords(spark, sf):
    df = reader(spark, sf)("customer").select(
        "c_custkey", (F.col("c_nationkey") % 12).cast("int").alias("root"),
        dims.pick(MODE_NAMES, F.col("c_custkey") % 11).alias("mode"),
        F.array(F.lit(1), (F.col("c_custkey") % 7 + 1).cast("int"), F.lit(5)).alias("degrees"),
    )
    chords = theory.progression_chords(F.col("root"), pitch.mode_offsets(F.col("mode")), F.col("degrees"))
    df = df.withColumn("chords", chords).withColumn("events", sequences.chain(F.col("chords"), plays=2))
    return _events(df, "c_custkey")


@query("V2", """
WITH keyed AS (SELECT p_partkey, CAST(60 + p_partkey % 12 AS INT) AS low, CAST(60 + p_partkey % 12 + p_size % 12 + 1 AS INT) AS high, p_partkey % 3 AS style FROM part)
SELECT p_partkey, CAST(i AS INT) AS seq, CAST(i AS INT) AS start_beat, CAST(i + 1 AS INT) AS end_beat,
       CASE WHEN style = 2 THEN low || ',' || high WHEN (style = 0) = (i % 2 = 0) THEN CAST(low AS VARCHAR) ELSE CAST(high AS VARCHAR) END AS notes
FROM keyed, range(8) r(i)""")
def interval_patterns(spark, sf):
    df = reader(spark, sf)("part").select(
        "p_partkey", (F.col("p_partkey") % 12 + 60).cast("int").alias("low"),
        (F.col("p_size") % 12 + 1).alias("size"), (F.col("p_partkey") % 3).cast("int").alias("style"),
    )
    pattern = sequences.interval_pattern(F.col("low"), F.col("size"), F.col("style"))
    return _events(df.withColumn("events", pattern), "p_partkey")


@query("V3 P4 W4", f"""
WITH {MODES}, keyed AS (
  SELECT c_custkey, CAST(c_nationkey % 12 AS INT) AS root, c_custkey % 2 AS style, offs || [12] AS steps
  FROM customer JOIN modes ON mode_ord = c_custkey % 11)
SELECT c_custkey, CAST(i AS INT) AS seq, CAST(i AS INT) AS start_beat, CAST(i + 1 AS INT) AS end_beat,
       CAST({tonic_sql('root')} + steps[CASE WHEN style = 1 THEN 8 - i ELSE i + 1 END] AS VARCHAR) AS notes
FROM keyed, range(8) r(i)""")
def scale_patterns(spark, sf):
    df = reader(spark, sf)("customer").select(
        "c_custkey", (F.col("c_nationkey") % 12).cast("int").alias("root"),
        (F.col("c_custkey") % 2).alias("style"), dims.pick(MODE_NAMES, F.col("c_custkey") % 11).alias("mode"),
    )
    pattern = sequences.scale_pattern(pitch.tonic_note(F.col("root")), pitch.mode_offsets(F.col("mode")), F.col("style"))
    return _events(df.withColumn("events", pattern), "c_custkey")


@query("W4", """
WITH lengths AS (SELECT o_orderkey, i, o_orderkey // (i + 1) % 7 + 1 AS d FROM orders, range(6) r(i))
SELECT o_orderkey, CAST(i AS INT) AS seq, CAST(coalesce(sum(d) OVER (PARTITION BY o_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM lengths""")
def running_beat_offsets(spark, sf):
    d = F.transform(
        F.sequence(F.lit(1), F.lit(6)), lambda i: F.call_function("div", F.col("o_orderkey"), i) % 7 + 1
    )
    df = reader(spark, sf)("orders").withColumn("starts", sequences.running_offsets(d))
    return unnest(df, "starts", "o_orderkey", index="seq", value="start")


def melody(key):
    """Five notes with a lead and gaps that depend on the key."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda i: sequences.event(
            key % 3 + i * 3, key % 3 + i * 3 + (key + i) % 3 + 1, F.array(((key * 5 + i * 7) % 128).cast("int"))
        ),
    )


# A melody as rows, then its messages: rest on, rest off, on, off in this order per note.
MELODY_SQL = """notes AS (
  SELECT c_custkey, i, c_custkey % 3 + i * 3 AS s, c_custkey % 3 + i * 3 + (c_custkey + i) % 3 + 1 AS e, (c_custkey * 5 + i * 7) % 128 AS note
  FROM customer, range(5) r(i)),
gaps AS (
  SELECT *, CASE WHEN i = 0 THEN greatest((s - 1) * 480, 0)
                 ELSE greatest((s - lag(e) OVER (PARTITION BY c_custkey ORDER BY i)) * 480, 0) END AS rest FROM notes)"""
MESSAGES_SQL = f"""{MELODY_SQL},
messages AS (
  SELECT c_custkey, i, k, CASE WHEN k % 2 = 0 THEN 'note_on' ELSE 'note_off' END AS kind,
         CASE WHEN k < 2 THEN 64 ELSE note END AS note, CASE WHEN k < 2 THEN 0 ELSE 64 END AS velocity,
         CASE k WHEN 1 THEN rest WHEN 3 THEN (e - s) * 480 ELSE 0 END AS delta
  FROM gaps, range(4) q(k) WHERE k >= 2 OR rest > 0)"""


@query("V4 V8", f"""
WITH {MESSAGES_SQL}
SELECT c_custkey, CAST(row_number() OVER w - 1 AS INT) AS seq, kind, CAST(note AS INT) AS note, velocity, CAST(delta AS INT) AS delta,
       CAST(sum(delta) OVER w AS BIGINT) AS tick
FROM messages WINDOW w AS (PARTITION BY c_custkey ORDER BY i, k)""")
def melody_messages(spark, sf):
    """Keys that are 3 x 128 apart have the same melody; a negative key has notes that fail the job."""
    key = F.col("c_custkey")
    df = reader(spark, sf)("customer").select("c_custkey", F.when(key < 0, key).otherwise(key % 384).alias("phase"))

    def build(keys):
        return keys.withColumn("messages", sequences.note_messages(melody(F.col("phase"))))

    return sequences.explode_shared_messages(df, build, ["phase"], "c_custkey")


@query("V5", f"""
WITH {MODES}, keyed AS (
  SELECT c_custkey, CAST(c_nationkey % 12 AS INT) AS root, offs FROM customer JOIN modes ON mode_ord = c_custkey % 11),
notes AS (
  SELECT c_custkey, c, n, c * (2 + c_custkey % 2) AS s, {tonic_sql('root')} + offs[(c + 2 * n) % 7 + 1] AS note
  FROM keyed, range(4) r(c), range(3) q(n)),
messages AS (
  SELECT c_custkey, c, 0 AS side, n, 'note_off' AS kind, 64 AS note, 0 AS velocity, 480 AS delta FROM notes WHERE c > 0 AND n = 0 AND c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, c, -1, n, 'note_on', 64, 0, 0 FROM notes WHERE c > 0 AND n = 0 AND c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, c, 1, n, 'note_on', note, 64, 0 FROM notes
  UNION ALL SELECT c_custkey, c, 2, n, 'note_off', note, 64, CASE WHEN n = 0 THEN 960 ELSE 0 END FROM notes)
SELECT c_custkey, CAST(row_number() OVER w - 1 AS INT) AS seq, kind, CAST(note AS INT) AS note, velocity, delta, CAST(sum(delta) OVER w AS BIGINT) AS tick
FROM messages WINDOW w AS (PARTITION BY c_custkey ORDER BY c, side, n)""")
def chord_messages(spark, sf):
    df = reader(spark, sf)("customer").select(
        "c_custkey", (F.col("c_nationkey") % 12).cast("int").alias("root"),
        dims.pick(MODE_NAMES, F.col("c_custkey") % 11).alias("mode"), (F.col("c_custkey") % 2 + 2).alias("apart"),
    )

    def build(keys):
        degrees = F.array(*[F.lit(d) for d in (1, 2, 3, 4)])
        chords = theory.progression_chords(F.col("root"), pitch.mode_offsets(F.col("mode")), degrees)
        apart = F.col("apart")
        events = F.transform("chords", lambda c, i: sequences.event(i * apart, i * apart + 2, c))
        made = keys.withColumn("chords", chords).withColumn("events", events)
        return made.withColumn("messages", sequences.note_messages(F.col("events")))

    return sequences.explode_shared_messages(df, build, ["root", "mode", "apart"], "c_custkey")


def click_settings(spark, sf, table, key):
    k = F.col(key)
    return reader(spark, sf)(table).select(
        key,
        dims.pick([m[0] for m in METERS], k % 8).alias("beats"),
        dims.pick([m[1] for m in METERS], k % 8).alias("division"),
        (k % 161 + 50).cast("int").alias("bpm"),
        (k % 3).cast("int").alias("level"),
        dims.pick_record(fv.CLICK_CONFIGS, CLICK_FIELDS, k % 5).alias("click"),
    )


def _click_sql(table: str, key: str) -> str:
    return f"""keyed AS (
  SELECT {key}, {nth([m[0] for m in METERS], f'{key} % 8')} AS beats, {nth([m[1] for m in METERS], f'{key} % 8')} AS division,
         CAST(50 + {key} % 161 AS INT) AS bpm, CAST({key} % 3 AS INT) AS level, {key} % 5 AS c FROM {table}),
tracks AS (SELECT *, CASE WHEN beats % 3 = 0 AND division <> 4 THEN 240 ELSE 1920 // division END AS unit,
           {nth([0, 63, 127], 'level')} AS reverb FROM keyed JOIN clicks ON click_ord = c)"""


@query("V6 P15 P17", f"""
WITH {CLICKS}, {_click_sql('supplier', 's_suppkey')},
steps AS (SELECT *, unnest(range(bpm // 3 + 1)) AS b FROM tracks),
messages AS (
  SELECT s_suppkey, -1 AS b, 0 AS k, 'control_change' AS kind, 91 AS note, reverb AS velocity, 0 AS delta FROM tracks
  UNION ALL
  SELECT s_suppkey, b, k, CASE k WHEN 0 THEN 'note_on' ELSE 'note_off' END, CASE WHEN b % beats = 0 THEN down ELSE off END,
         CASE WHEN b % beats = 0 THEN down_vel ELSE off_vel END, CASE k WHEN 0 THEN 0 ELSE unit END FROM steps, range(2) q(k))
SELECT s_suppkey, CAST(row_number() OVER w - 1 AS INT) AS seq, kind, note, velocity, CAST(delta AS INT) AS delta, CAST(sum(delta) OVER w AS BIGINT) AS tick
FROM messages WINDOW w AS (PARTITION BY s_suppkey ORDER BY b, k)""")
def click_messages(spark, sf):
    df = click_settings(spark, sf, "supplier", "s_suppkey")
    messages = sequences.click_messages(
        F.col("beats"), F.col("division"), pitch.tempo_beats(F.col("bpm")), F.col("click"), F.col("level")
    )
    return sequences.explode_messages(df.withColumn("messages", messages), "messages", "s_suppkey")


@query("V6 V8 P16", f"""
WITH {CLICKS}, {_click_sql('part', 'p_partkey')},
timed AS (SELECT *, (bpm // 3 + 1) * unit AS ticks, CAST(round_even(60000000.0 / bpm, 0) AS BIGINT) AS tempo FROM tracks)
SELECT p_partkey, CAST(2 * (bpm // 3 + 1) + 1 AS INT) AS n_messages, CAST(ticks AS BIGINT) AS ticks,
       round(ticks * tempo / 480000000.0, 6) + 0.0 AS seconds, CAST(floor(ticks * tempo / CAST(480000000.0 AS DOUBLE) * 44100) AS BIGINT) AS n_samples
FROM timed""")
def click_track_durations(spark, sf):
    df = click_settings(spark, sf, "part", "p_partkey")
    total = pitch.tempo_beats(F.col("bpm"))
    df = df.withColumn("ticks", sequences.click_ticks(F.col("beats"), F.col("division"), total))
    seconds = sequences.tick_seconds(F.col("ticks"), F.col("bpm"))
    return df.select(
        "p_partkey", (sequences.click_count(total) * 2 + 1).alias("n_messages"), "ticks", rounded(seconds).alias("seconds"),
        sequences.sample_count(seconds).alias("n_samples"),
    )


@query("V7 P16", f"""
SELECT p_partkey, p_name AS track_name, {nth([m[0] for m in METERS], 'p_partkey % 8')} AS numerator,
       {nth([m[1] for m in METERS], 'p_partkey % 8')} AS denominator, CAST(round_even(60000000.0 / (50 + p_partkey % 161), 0) AS INT) AS tempo,
       CAST(p_partkey % 128 AS INT) AS program, 2 AS channel, 480 AS ticks_per_beat
FROM part""")
def track_headers(spark, sf):
    k = F.col("p_partkey")
    header = sequences.track_header(
        F.col("p_name"), dims.pick([m[0] for m in METERS], k % 8), dims.pick([m[1] for m in METERS], k % 8),
        (k % 161 + 50).cast("int"), k % 128, F.lit(2),
    )
    return reader(spark, sf)("part").select("p_partkey", header.alias("h")).select("p_partkey", "h.*")

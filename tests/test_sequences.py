"""Events, messages and click tracks."""

import pytest
from pyspark.sql import functions as F

from gridprobe.catalog import QUERIES
from gridprobe.functions import fixed_values as fv
from gridprobe.functions import pitch
from gridprobe.operators import grid, sequences
from gridprobe.plans import datasets as ds


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def starts_and_notes(events):
    return [(e["start_beat"], e["end_beat"], e["notes"]) for e in events]


def test_scale_up_and_down(spark):
    offsets = pitch.mode_offsets(F.lit("ionian"))
    up = one(spark, sequences.scale_pattern(F.lit(60), offsets, F.lit(0)))
    down = one(spark, sequences.scale_pattern(F.lit(60), offsets, F.lit(1)))
    notes = [60, 62, 64, 65, 67, 69, 71, 72]
    assert starts_and_notes(up) == [(i, i + 1, [n]) for i, n in enumerate(notes)]
    assert starts_and_notes(down) == [(i, i + 1, [n]) for i, n in enumerate(reversed(notes))]


@pytest.mark.parametrize("style, pair", [(0, [[60], [67]]), (1, [[67], [60]]), (2, [[60, 67], [60, 67]])])
def test_interval(spark, style, pair):
    events = one(spark, sequences.interval_pattern(F.lit(60), F.lit(7), F.lit(style)))
    assert starts_and_notes(events) == [(i, i + 1, n) for i, n in enumerate(pair * 4)]


def messages(spark, events):
    array = F.array(*[sequences.event(F.lit(s), F.lit(e), F.lit(n)) for s, e, n in events])
    return [tuple(m) for m in one(spark, sequences.note_messages(array))]


def test_rests_and_chords(spark):
    got = messages(spark, [(2, 3, [60]), (5, 7, [60, 64])])
    assert got == [
        ("note_on", 64, 0, 0), ("note_off", 64, 0, 480),
        ("note_on", 60, 64, 0), ("note_off", 60, 64, 480),
        ("note_on", 64, 0, 0), ("note_off", 64, 0, 960),
        ("note_on", 60, 64, 0), ("note_on", 64, 64, 0), ("note_off", 60, 64, 960), ("note_off", 64, 64, 0),
    ]


def test_note_out_of_range_fails(spark):
    with pytest.raises(Exception, match="note outside 0..127: 130"):
        messages(spark, [(0, 1, [130])])


@pytest.mark.parametrize("name", ["notes", "intervals", "scales", "chords", "chord_progressions"])
def test_pitched_samples_last_four_seconds(spark, name):
    df = ds.with_events(ds.full_table(spark, name), name)
    ticks = sequences.total_ticks(sequences.note_messages(F.col("events")))
    got = df.select(ticks.alias("t"), sequences.tick_seconds(ticks, F.lit(120)).alias("s")).distinct().collect()
    assert [(r["t"], r["s"]) for r in got] == [(3840, 4.0)]


def test_clicks(spark):
    tempos = ds.with_clicks(ds.full_table(spark, "tempos"), "tempos").filter("offset_file_path LIKE '%offset_0.wav'")
    sizes = tempos.filter("bpm in (50, 120, 210)").select("bpm", ((F.size("messages") - 1) / 2).alias("c")).distinct()
    assert {r["bpm"]: r["c"] for r in sizes.collect()} == {50: 17, 120: 41, 210: 71}
    first = tempos.filter("bpm = 50 and click_config_name = 'taiko'").first()["messages"][:6]
    assert [tuple(m) for m in first] == [
        ("control_change", 91, 0, 0), ("note_on", 52, 100, 0), ("note_off", 52, 100, 480),
        ("note_on", 48, 75, 0), ("note_off", 48, 75, 480), ("note_on", 48, 75, 0),
    ]


def test_click_length_in_closed_form(spark):
    df = ds.with_clicks(ds.full_table(spark, "time_signatures"), "time_signatures")
    beats, division = F.col("time_signature_beats"), F.col("time_signature_subdivision")
    closed = sequences.click_ticks(beats, division, pitch.signature_beats(division, F.col("bpm")))
    assert df.filter(closed != sequences.total_ticks(F.col("messages"))).isEmpty()


def test_running_offsets(spark):
    assert one(spark, sequences.running_offsets(F.lit([3, 1, 4]).cast("array<bigint>"))) == [0, 3, 4]


def test_explode_messages_accumulates_ticks(spark):
    df = spark.range(1).withColumn("m", sequences.note_messages(F.array(
        sequences.event(F.lit(0), F.lit(2), F.lit([60])), sequences.event(F.lit(2), F.lit(3), F.lit([62]))
    )))
    rows = sequences.explode_messages(df, "m", "id").orderBy("seq").collect()
    assert [r["tick"] for r in rows] == [0, 960, 960, 1440]


def test_shared_messages_equal_those_built_per_row(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("gap"), (F.col("id") % 2).alias("low"), F.lit("x").alias("kind"))

    def build(keys):
        start, note = F.coalesce("gap", F.lit(0)), (F.col("low") + 60).cast("int")
        events = F.array(sequences.event(start, start + 1, F.array(note)), sequences.event(start + 2, start + 3, F.array(note, note + 4)))
        return keys.withColumn("messages", sequences.note_messages(events))

    shared = sequences.explode_shared_messages(df, build, ["gap", "low"], "id")
    per_row = sequences.explode_messages(build(df), "messages", "id")
    assert shared.schema == per_row.schema
    got, wanted = ([tuple(r) for r in d.orderBy("id", "seq").collect()] for d in (shared, per_row))
    assert got == wanted and len({r[0] for r in got}) == 40


@pytest.mark.parametrize("name", ["chord_messages", "melody_messages"])
def test_tracks_are_built_once_per_key(spark, sf, name):
    """Built per customer, a track of chords cost 170 microseconds."""
    plan = QUERIES[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("BroadcastHashJoin") < plan.index("BroadcastExchange") < plan.index("Generate")
    assert "HashAggregate" in plan[plan.index("Generate"):]


def test_track_header(spark):
    header = one(spark, sequences.track_header(*[F.lit(v) for v in ("Piano", 4, 4, 120, 0, 2)]))
    assert header["tempo"] == 500_000 and header["ticks_per_beat"] == fv.TICKS_PER_BEAT


def test_grid_ids_are_dense(spark):
    rows = grid.with_ordinals(grid.grid_ids(spark, [108, 92]), "row_id", a=108, b=92)
    assert tuple(rows.orderBy(F.desc("row_id")).first()) == (9935, 107, 91)

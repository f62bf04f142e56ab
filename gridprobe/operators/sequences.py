"""Note events and messages.

A sample's events are an array in its row, in playing order. Every operator here is row-local, but for
``explode_shared_messages``: a message looks at its neighbour through the array index, so no window and no
shuffle is needed, and a sample's events are as many as its row already holds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import fixed_values as fv
from gridprobe.functions import pitch
from gridprobe.functions.binding import let
from gridprobe.operators.unnest import unnest


def event(start: Column, end: Column, notes: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start_beat"), end.cast("int").alias("end_beat"), notes.alias("notes")
    )


def repeated(notes: Column, plays: int = 4, beats: int = 2) -> Column:
    """The same note or chord, played back to back."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(plays - 1)), lambda i: event(i * beats, (i + 1) * beats, notes)
    )


def chain(chords: Column, plays: int = 1, beats: int = 2) -> Column:
    """Chords in turn, each played ``plays`` times."""
    nested = F.transform(
        chords,
        lambda notes, c: F.transform(
            F.sequence(F.lit(0), F.lit(plays - 1)),
            lambda p: event((c * plays + p) * beats, (c * plays + p + 1) * beats, notes),
        ),
    )
    return F.flatten(nested)


def interval_pattern(low: Column, size: Column, style: Column) -> Column:
    """Eight one-beat events: low-high, high-low, or both at once."""
    high = (low + size).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: event(
            i,
            i + 1,
            F.when(style == 2, F.array(low, high))
            .when((i + style) % 2 == 0, F.array(low))
            .otherwise(F.array(high)),
        ),
    )


def scale_pattern(tonic: Column, offsets: Column, style: Column, octave_above: bool = True) -> Column:
    """The scale up (or down for style 1), one beat per note."""
    steps = F.concat(offsets, F.array(F.lit(12))) if octave_above else offsets
    climb = F.transform(steps, lambda o: (tonic + o).cast("int"))
    notes = F.when(style == 1, F.reverse(climb)).otherwise(climb)
    return F.transform(notes, lambda n, i: event(i, i + 1, F.array(n)))


def running_offsets(durations: Column) -> Column:
    """Start offset of each event from irregular durations, in order."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    folded = F.aggregate(
        durations,
        zero,
        lambda acc, d: F.struct(
            (acc["at"] + d).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")
        ),
    )
    return folded["starts"]


def message(kind: str, note: Column, velocity: Column | int, delta: Column | int) -> Column:
    as_int = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(
        F.lit(kind).alias("kind"),
        as_int(note).alias("note"),
        as_int(velocity).alias("velocity"),
        as_int(delta).alias("delta"),
    )


def _ticks(beats: Column) -> Column:
    return F.floor(beats * fv.TICKS_PER_BEAT).cast("int")


def _rest(ticks: Column) -> Column:
    pause = F.array(
        message("note_on", F.lit(fv.REST_NOTE), 0, 0), message("note_off", F.lit(fv.REST_NOTE), 0, ticks)
    )
    return F.when(ticks > 0, pause).otherwise(F.slice(pause, 1, 0))


def note_messages(events: Column) -> Column:
    """On and off messages of a melody or a chord sequence, with delta ticks.

    Before the first event a rest lasts one beat less than its start; between events a rest fills
    each gap. All notes of an event start together, and the first off message carries the duration.
    """

    def one(events: Column, e: Column, i: Column) -> Column:
        first = F.greatest(_ticks(e["start_beat"] - 1), F.lit(0))
        gap = e["start_beat"] - F.element_at(events, F.greatest(i, F.lit(1)))["end_beat"]
        rest = F.when(i == 0, first).otherwise(F.greatest(_ticks(gap), F.lit(0)))
        held = _ticks(e["end_beat"] - e["start_beat"])
        notes = F.transform(e["notes"], pitch.midi_note)
        on = F.transform(notes, lambda n: message("note_on", n, fv.NOTE_VELOCITY, 0))
        off = F.transform(
            notes, lambda n, k: message("note_off", n, fv.NOTE_VELOCITY, F.when(k == 0, held).otherwise(0))
        )
        return F.concat(_rest(rest), on, off)

    return let(events, lambda ev: F.flatten(F.transform(ev, lambda e, i: one(ev, e, i))))


def click_messages(beats_per_bar: Column, division: Column, total_beats: Column, click: Column, reverb: Column) -> Column:
    """A reverb message, then one click per beat and one more; the first beat of a bar is accented."""
    unit = pitch.beat_ticks(beats_per_bar, division)
    control = message("control_change", F.lit(fv.REVERB_CONTROL), pitch.reverb_value(reverb), 0)

    def one(b: Column) -> Column:
        accent = b % beats_per_bar == 0
        note = F.when(accent, click["downbeat_note"]).otherwise(click["offbeat_note"])
        velocity = F.when(accent, click["downbeat_velocity"]).otherwise(click["offbeat_velocity"])
        return F.array(message("note_on", note, velocity, 0), message("note_off", note, velocity, unit))

    beats = F.sequence(F.lit(0), F.ceil(total_beats).cast("int"))
    return F.concat(F.array(control), F.flatten(F.transform(beats, one)))


def click_count(total_beats: Column) -> Column:
    return (F.ceil(total_beats) + 1).cast("int")


def click_ticks(beats_per_bar: Column, division: Column, total_beats: Column) -> Column:
    """Length of a click track in ticks, without building its messages."""
    return click_count(total_beats).cast("bigint") * pitch.beat_ticks(beats_per_bar, division)


def total_ticks(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("bigint"), lambda acc, m: acc + m["delta"])


def tick_seconds(ticks: Column, bpm: Column) -> Column:
    return ticks * pitch.quarter_micros(bpm) / F.lit(1_000_000.0 * fv.TICKS_PER_BEAT)


def sample_count(seconds: Column) -> Column:
    return F.floor(seconds * fv.SAMPLE_RATE).cast("bigint")


def explode_messages(df: DataFrame, messages: str, *keep: str) -> DataFrame:
    """One row per message with its place and absolute tick."""
    starts = running_offsets(F.transform(F.col(messages), lambda m: m["delta"].cast("bigint")))
    rows = unnest(df, F.arrays_zip(F.col(messages).alias("m"), starts.alias("at")), *keep, index="seq", value="z")
    # The tick of a message includes its own delta. It is added on rows, where the code is compiled.
    return rows.select(*keep, "seq", "z.m.*", (F.col("z.at") + F.col("z.m.delta")).alias("tick"))


def explode_shared_messages(df: DataFrame, build: Callable[[DataFrame], DataFrame], by: list[str], *keep: str) -> DataFrame:
    """Like ``explode_messages`` for a large table whose messages depend on the short columns ``by`` alone.

    ``build`` adds ``messages`` to a table of these columns. A track is built once per distinct value of them,
    and rows look theirs up in a broadcast table, where NULL meets NULL. The values must be few by the music,
    as twelve roots and eleven modes are, whatever the number of rows.
    """
    tracks = explode_messages(build(df.select(*by).distinct()), "messages", *by)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    rows = df.select(*dict.fromkeys([*keep, *by])).join(F.broadcast(tracks.withColumnsRenamed({c: f"_{c}" for c in by})), same)
    return rows.select(*keep, "seq", "kind", "note", "velocity", "delta", "tick")


def explode_events(df: DataFrame, events: str, *keep: str) -> DataFrame:
    """The event table: one row per event, in order."""
    return unnest(df, events, *keep, index="seq", value="e").select(*keep, "seq", "e.*")


def track_header(name: Column, beats: Column, division: Column, bpm: Column, program: Column, channel: Column) -> Column:
    return F.struct(
        name.alias("track_name"),
        beats.cast("int").alias("numerator"),
        division.cast("int").alias("denominator"),
        pitch.quarter_micros(bpm).alias("tempo"),
        program.cast("int").alias("program"),
        channel.cast("int").alias("channel"),
        F.lit(fv.TICKS_PER_BEAT).alias("ticks_per_beat"),
    )

"""Pitch, scale and meter columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridprobe.functions import fixed_values as fv
from gridprobe.functions.literals import literal, literal_map


def known(value: Column, key: Column, what: str) -> Column:
    """A looked-up value; an unknown key fails the job with its name."""
    text = F.concat(F.lit(f"unknown {what}: "), F.coalesce(key.cast("string"), F.lit("null")))
    return F.coalesce(value, F.raise_error(text))


def sharp_name(pitch_class: Column) -> Column:
    return F.element_at(literal(fv.SHARP_NAMES), (pitch_class + 1).cast("int"))


def spellings(pitch_class: Column) -> Column:
    return F.element_at(literal(fv.ENHARMONIC_NAMES), (pitch_class + 1).cast("int"))


def pitch_class_of(name: Column) -> Column:
    return known(F.try_element_at(literal_map(fv.PITCH_CLASS_OF_NAME), name), name, "note name")


def mode_offsets(mode: Column) -> Column:
    return known(F.try_element_at(literal_map(fv.MODE_OFFSETS), mode), mode, "mode")


def scale_of(root: Column, offsets: Column) -> Column:
    return F.transform(offsets, lambda step: F.pmod(root + step, F.lit(12)).cast("int"))


def tonic_note(pitch_class: Column) -> Column:
    """The note of a key centre nearest to middle C; six keys lie below it."""
    above = F.lit(fv.MIDDLE_C) + pitch_class
    return F.when(pitch_class <= 5, above).otherwise(above - 12).cast("int")


def degree_pitch(scale: Column, offsets: Column, degree: Column, octave: Column) -> Column:
    """(pitch class, note) of a degree such as ``b7``.

    The last character is the degree and the first one the accidental. The pitch class is not
    folded back into 0..11.
    """
    usable = F.when(
        F.length(F.coalesce(degree, F.lit(""))) == 0, F.raise_error(F.lit("blank scale degree"))
    ).otherwise(degree)
    step = F.substring(usable, -1, 1).cast("int")
    first = F.substring(usable, 1, 1)
    shift = F.when(F.length(usable) == 1, F.lit(0)).otherwise(
        known(F.try_element_at(literal_map(fv.ACCIDENTAL_SHIFT), first), first, "accidental")
    )
    note = tonic_note(scale[0]) + F.element_at(offsets, step) + shift + octave * 12
    return F.struct(
        (F.element_at(scale, step) + shift).cast("int").alias("pitch_class"),
        note.cast("int").alias("note"),
    )


def octave_of(note: Column) -> Column:
    return F.floor(note / 12).cast("int")


def register_of(note: Column) -> Column:
    low, mid, high = fv.REGISTER_CUTS
    octave = octave_of(note)
    return (
        F.when(octave < low, 0).when(octave < mid, 1).when(octave < high, 2).otherwise(3)
    )


def is_accidental(name: Column) -> Column:
    return F.endswith(name, F.lit("#"))


def is_compound(beats: Column, division: Column) -> Column:
    return (beats % 3 == 0) & (division != 4)


def quarter_micros(bpm: Column) -> Column:
    """Microseconds per quarter note; the meter plays no part."""
    return F.bround(F.lit(60_000_000.0) / bpm).cast("int")


def reverb_value(level: Column) -> Column:
    return known(F.try_element_at(literal_map(fv.REVERB_VALUES), level), level, "reverb level")


def midi_note(note: Column) -> Column:
    """The note, or a failed job if it lies outside 0..127."""
    problem = F.raise_error(F.concat(F.lit("note outside 0..127: "), note.cast("string")))
    return F.when(note.between(0, 127), note).otherwise(problem)


def tempo_beats(bpm: Column) -> Column:
    """Beats in about 20 seconds."""
    return F.floor(bpm / 3).cast("int")


def signature_beats(division: Column, bpm: Column) -> Column:
    """Beats in about 30 seconds, counted in the signature's own unit."""
    return F.floor(division / F.lit(4.0) * F.floor(bpm / 2)).cast("int")


def beat_ticks(beats: Column, division: Column) -> Column:
    return (
        F.when(is_compound(beats, division), F.lit(fv.TICKS_PER_BEAT // 2))
        .otherwise(F.floor(F.lit(fv.TICKS_PER_BEAT) * 4 / division))
        .cast("int")
    )

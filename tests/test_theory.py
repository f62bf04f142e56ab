"""Hand-worked chords, scales, degrees and meters."""

import pytest
from pyspark.sql import functions as F

from gridprobe.functions import fixed_values as fv
from gridprobe.functions import pitch
from gridprobe.operators import theory


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("pc, note", [(0, 60), (5, 65), (6, 54), (11, 59)])
def test_tonic(spark, pc, note):
    assert one(spark, pitch.tonic_note(F.lit(pc))) == note


NAMED = [
    (0, "major", None, [60, 64, 67], "CMaj[]"),
    (0, "major", "6", [64, 67, 72], "EMaj6[]"),
    (0, "major", "64", [67, 72, 76], "GMaj64[]"),
    (0, "aug", None, [60, 64, 68], "CA[]"),
    (8, "aug", None, [68, 72, 76], "G#A[]"),
    (11, "dim", None, [59, 62, 65], "Bd[]"),
    (6, "major", None, [54, 58, 61], "F#Maj[]"),
    (0, "dom7", None, [60, 64, 67, 70], "CMaj7[]"),
]


@pytest.mark.parametrize("build", [theory.add_named_chord, theory.join_named_chord])
def test_named_chords(spark, build):
    rows = spark.createDataFrame([(r, k, i) for r, k, i, _, _ in NAMED], "r int, k string, i string")
    got = {(x["r"], x["k"], x["i"]): (x["chord"]["notes"], x["chord"]["name"]) for x in build(rows, "r", "k", "i").collect()}
    assert got == {(r, k, i): (n, name) for r, k, i, n, name in NAMED}


def test_unknown_chord_kind_fails(spark):
    rows = spark.createDataFrame([(0, "sus4")], "r int, k string")
    with pytest.raises(Exception, match="unknown chord kind: sus4"):
        theory.add_named_chord(rows, "r", "k").collect()
    with pytest.raises(Exception, match="unknown chord kind: sus4"):
        theory.join_named_chord(rows, "r", "k").collect()


def test_dictionary_equals_direct_chords(spark):
    keyed = spark.range(12 * 11 * 7 * 5 * 3).select(
        (F.col("id") % 12).cast("int").alias("r"),
        F.element_at(F.lit(list(fv.MODE_OFFSETS)), (F.col("id") % 11 + 1).cast("int")).alias("m"),
        (F.col("id") % 7 + 1).cast("int").alias("d"),
        F.element_at(F.lit([5, 7, 9, 11, 13]), (F.col("id") % 5 + 1).cast("int")).alias("t"),
        F.element_at(F.array(F.lit(None).cast("string"), F.lit("6"), F.lit("64")), (F.col("id") % 3 + 1).cast("int")).alias("i"),
    )
    direct = theory.add_chord(keyed, "r", "m", "d", "t", "i")
    joined = theory.join_chord(keyed, "r", "m", "d", "t", "i")
    assert direct.exceptAll(joined).isEmpty() and joined.exceptAll(direct).isEmpty()


def test_extension_and_borrowing(spark):
    row = spark.createDataFrame([(0, "ionian", 1, 5, [9], None), (0, "ionian", 1, 5, [], "aeolian")],
                                "r int, m string, d int, t int, e array<int>, b string")
    added, lent = [x["chord"] for x in theory.add_chord(row, "r", "m", "d", "t", None, "e", "b").collect()]
    assert (added["pitch_classes"], added["notes"], added["name"]) == ([0, 4, 7, 4], [60, 64, 67, 76], "CMaj[add9]")
    assert (lent["notes"], lent["name"]) == ([60, 63, 67], "Cm[ (aeolian)]")


def test_progression(spark):
    offsets = pitch.mode_offsets(F.lit("ionian"))
    chords = theory.progression_chords(F.lit(0), offsets, F.lit([1, 4, 5, 1]))
    assert one(spark, chords) == [[60, 64, 67], [65, 69, 60], [67, 71, 62], [60, 64, 67]]
    typed = F.from_json(
        F.lit('[{"degree": 1, "chord_type": 5}, {"degree": 5, "chord_type": 7}]'),
        "array<struct<degree int, chord_type int>>",
    )
    assert one(spark, theory.typed_progression_chords(F.lit(0), offsets, typed)) == [[60, 64, 67], [67, 71, 62, 65]]


@pytest.mark.parametrize("degree, expected", [("b7", (10, 70)), ("b1", (-1, 59)), ("bb7", (10, 70)), ("#4", (6, 66)), ("5", (7, 67))])
def test_degrees(spark, degree, expected):
    offsets = pitch.mode_offsets(F.lit("ionian"))
    got = one(spark, pitch.degree_pitch(pitch.scale_of(F.lit(0), offsets), offsets, F.lit(degree), F.lit(0)))
    assert (got["pitch_class"], got["note"]) == expected


@pytest.mark.parametrize("column, message", [
    (lambda: pitch.mode_offsets(F.lit("blues")), "unknown mode: blues"),
    (lambda: pitch.pitch_class_of(F.lit("H")), "unknown note name: H"),
    (lambda: pitch.reverb_value(F.lit(3)), "unknown reverb level: 3"),
    (lambda: pitch.midi_note(F.lit(128)), "note outside 0..127: 128"),
    (lambda: pitch.degree_pitch(F.array(F.lit(0)), F.array(F.lit(0)), F.lit(""), F.lit(0)), "blank scale degree"),
])
def test_domain_guards(spark, column, message):
    with pytest.raises(Exception, match=message):
        spark.range(1).select(column()).collect()


def test_registers_and_meters(spark):
    notes = [(o * 12,) for o in (2, 3, 5, 6, 8)]
    df = spark.createDataFrame(notes, "n int").select(pitch.register_of(F.col("n")).alias("r"))
    assert [x["r"] for x in df.collect()] == [0, 1, 1, 2, 2]
    meters = spark.createDataFrame(list(fv.TIME_SIGNATURES), "b int, d int")
    rows = meters.select(
        "b", "d", pitch.is_compound(F.col("b"), F.col("d")).alias("c"), pitch.beat_ticks(F.col("b"), F.col("d")).alias("t"),
        (pitch.signature_beats(F.col("d"), F.lit(120)) + 1).alias("clicks"),
    ).collect()
    assert [(r["b"], r["d"]) for r in rows if r["c"]] == [(3, 8), (6, 8), (9, 8), (12, 8)]
    ticks = {(r["b"], r["d"]): r["t"] for r in rows}
    assert [ticks[m] for m in ((2, 2), (2, 4), (3, 4), (3, 8), (6, 8))] == [960, 480, 480, 240, 240]
    clicks = {(r["b"], r["d"]): r["clicks"] for r in rows}
    assert [clicks[m] for m in ((2, 2), (4, 4), (6, 8))] == [31, 61, 121]

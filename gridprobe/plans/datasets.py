"""The seven label tables.

Each builder takes a table of row ids and adds the labels of the grid row that the id decodes to;
ids past the grid start over. ``grid_sizes`` gives the dimensions of the full grids. Dimension values
are short literal lists, so a label table is one projection of its ids: no join, no shuffle, any size.

``is_silent`` and ``offset_time`` come from waveforms and are NULL unless given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe import schemas
from gridprobe.functions import dims, naming, pitch
from gridprobe.functions import fixed_values as fv
from gridprobe.functions.literals import literal_records
from gridprobe.operators import grid, sequences, theory

Instruments = Sequence[tuple[str, int, str]]

INTERVALS = tuple((b, s) for b in fv.INTERVAL_BASES for s in fv.INTERVAL_SIZES)
SCALES = tuple((n, m) for n in fv.SHARP_NAMES for m in fv.SCALE_MODES)
CHORDS = tuple((pc, k) for pc in range(12) for k in fv.CHORD_KINDS)
KEYS = tuple(range(12))
CLICK_FIELDS = (
    "channel", "program", "downbeat_note", "offbeat_note", "name", "downbeat_velocity", "offbeat_velocity",
)
BPMS = tuple(range(fv.SLOWEST_BPM, fv.FASTEST_BPM + 1))


def _instruments(given: Instruments | None) -> Instruments:
    return dims.pitched_instrument_rows() if given is None else list(given)


def _instrument(rows: Instruments, ordinal: str) -> Column:
    return dims.pick_record(rows, ("category", "program", "name"), F.col(ordinal))


def _finish(df: DataFrame, dataset: str, row_id: str, is_silent: Column | None, offset_time: Column | None = None):
    """Project the columns of the dataset schema, in order and with its types."""
    fixed = {
        "row_id": F.col(row_id),
        "synth_soundfont": F.lit(fv.SOUNDFONT),
        "is_silent": F.lit(None) if is_silent is None else is_silent,
        "offset_time": F.lit(None) if offset_time is None else offset_time,
    }
    fields = [part.split(" ", 1) for part in schemas.DATASETS[dataset].split(", ")]
    return df.select(*[fixed.get(n, F.col(n) if n not in fixed else None).cast(t).alias(n) for n, t in fields])


def _with_instrument(df: DataFrame, *name_parts: Column) -> DataFrame:
    """Instrument columns and the two file names of a pitched sample."""
    program = F.col("_inst.program")
    stem = naming.stem(*name_parts, program.cast("string"), naming.slug(F.col("_inst.name")))
    return df.withColumns({
        "midi_program_num": program,
        "midi_program_name": F.col("_inst.name"),
        "midi_category": F.col("_inst.category"),
        "midi_file_path": naming.with_suffix(stem, ".mid"),
        "synth_file_path": naming.with_suffix(stem, ".wav"),
    })


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def notes(ids, midi_values: Sequence[int] = tuple(range(fv.NOTE_COUNT)), instruments: Instruments | None = None,
          row_id: str = "row_id", is_silent: Column | None = None) -> DataFrame:
    rows = _instruments(instruments)
    df = grid.with_ordinals(ids, row_id, _n=len(midi_values), _i=len(rows))
    df = df.withColumns({"midi_note_val": dims.pick(midi_values, F.col("_n")), "_inst": _instrument(rows, "_i")})
    note = F.col("midi_note_val")
    df = df.withColumns({
        "root_note_pitch_class": note % 12,
        "root_note_name": pitch.sharp_name(note % 12),
        "octave": pitch.octave_of(note),
        "register": pitch.register_of(note),
        "root_note_is_accidental": pitch.is_accidental(pitch.sharp_name(note % 12)),
    })
    df = _with_instrument(df, _text("midi_note_val"), _text("register"), F.col("root_note_name"))
    return _finish(df, "notes", row_id, is_silent)


def intervals(ids, pairs: Sequence[tuple[int, int]] = INTERVALS, instruments: Instruments | None = None,
              row_id: str = "row_id", is_silent: Column | None = None) -> DataFrame:
    rows = _instruments(instruments)
    df = grid.with_ordinals(ids, row_id, _p=len(pairs), play_style=len(fv.INTERVAL_STYLES), _i=len(rows))
    df = df.withColumns({
        "_pair": dims.pick_record(pairs, ("base", "size"), F.col("_p")),
        "play_style_name": dims.pick(fv.INTERVAL_STYLES, F.col("play_style")),
        "_inst": _instrument(rows, "_i"),
    })
    base = F.col("_pair.base")
    df = df.withColumns({
        "midi_note_val": base,
        "interval": F.col("_pair.size"),
        "root_note_pitch_class": base % 12,
        "root_note_name": pitch.sharp_name(base % 12),
    })
    df = _with_instrument(df, F.col("root_note_name"), _text("interval"), F.col("play_style_name"))
    return _finish(df, "intervals", row_id, is_silent)


def scales(ids, pairs: Sequence[tuple[str, str]] = SCALES, instruments: Instruments | None = None,
           row_id: str = "row_id", is_silent: Column | None = None) -> DataFrame:
    rows = _instruments(instruments)
    df = grid.with_ordinals(ids, row_id, _p=len(pairs), play_style=len(fv.SCALE_STYLES), _i=len(rows))
    df = df.withColumns({
        "_pair": dims.pick_record(pairs, ("root", "mode"), F.col("_p")),
        "play_style_name": dims.pick(fv.SCALE_STYLES, F.col("play_style")),
        "_inst": _instrument(rows, "_i"),
    })
    df = df.withColumns({"root_note_name": F.col("_pair.root"), "mode": F.col("_pair.mode")})
    df = _with_instrument(df, F.col("root_note_name"), F.col("mode"), F.col("play_style_name"))
    return _finish(df, "scales", row_id, is_silent)


def chords(ids, pairs: Sequence[tuple[int, str]] = CHORDS, instruments: Instruments | None = None,
           row_id: str = "row_id", is_silent: Column | None = None) -> DataFrame:
    rows = _instruments(instruments)
    df = grid.with_ordinals(ids, row_id, _p=len(pairs), _v=len(fv.INVERSIONS), _i=len(rows))
    df = df.withColumns({
        "_pair": dims.pick_record(pairs, ("root", "kind"), F.col("_p")),
        "inversion": F.coalesce(dims.pick(fv.INVERSIONS, F.col("_v")), F.lit("5")),
        "_inst": _instrument(rows, "_i"),
    })
    df = df.withColumns({
        "root_note_pitch_class": F.col("_pair.root"),
        "chord_type": F.col("_pair.kind"),
        "root_note_name": pitch.sharp_name(F.col("_pair.root")),
        "root_note_is_accidental": pitch.is_accidental(pitch.sharp_name(F.col("_pair.root"))),
    })
    df = _with_instrument(df, F.col("root_note_name"), F.col("chord_type"), F.col("inversion"))
    return _finish(df, "chords", row_id, is_silent)


def check_unique(progressions: Sequence) -> None:
    if len(set(progressions)) != len(progressions):
        raise ValueError("progressions repeat")


def _progression(progressions: Sequence, ordinal: str) -> Column:
    return dims.pick_record(progressions, ("mode", "degrees"), F.col(ordinal))


def progressions(ids, progressions: Sequence = fv.PROGRESSIONS, keys: Sequence[int] = KEYS,
                 instruments: Instruments | None = None, row_id: str = "row_id",
                 is_silent: Column | None = None) -> DataFrame:
    check_unique(progressions)
    rows = _instruments(instruments)
    df = grid.with_ordinals(ids, row_id, _k=len(keys), _p=len(progressions), _i=len(rows))
    df = df.withColumns({
        "key_note_pitch_class": dims.pick(keys, F.col("_k")),
        "_prog": _progression(progressions, "_p"),
        "_inst": _instrument(rows, "_i"),
    })
    mode, degrees = F.col("_prog.mode"), F.col("_prog.degrees")
    df = df.withColumns({
        "key_note_name": pitch.sharp_name(F.col("key_note_pitch_class")),
        "chord_progression": F.concat(mode, F.lit("-"), naming.tuple_text(degrees)),
    })
    df = _with_instrument(df, F.col("key_note_name"), mode, naming.dashed(degrees))
    return _finish(df, "chord_progressions", row_id, is_silent)


def _click(configs: Sequence, ordinal: str) -> Column:
    return dims.pick_record(configs, CLICK_FIELDS, F.col(ordinal))


def _with_click_files(df: DataFrame, stem: Column) -> DataFrame:
    offset = naming.stem(stem, "offset", _text("offset_index"))
    return df.withColumns({
        "click_config_name": F.col("_click.name"),
        "midi_program_num": F.col("_click.program"),
        "midi_file_path": naming.with_suffix(stem, ".mid"),
        "synth_file_path": naming.with_suffix(stem, ".wav"),
        "offset_file_path": naming.with_suffix(offset, ".wav"),
    })


def tempos(base_ids, bpms: Sequence[int] = BPMS, configs: Sequence = fv.CLICK_CONFIGS, offsets: int = fv.TEMPO_OFFSETS,
           row_id: str = "row_id", is_silent: Column | None = None, offset_time: Column | None = None) -> DataFrame:
    """One base id per click track; every track fans out into ``offsets`` crops."""
    df = grid.with_ordinals(base_ids, row_id, _b=len(bpms), _c=len(configs))
    df = df.withColumns({"bpm": dims.pick(bpms, F.col("_b")), "_click": _click(configs, "_c")})
    df = grid.fan_out(df, row_id, offsets)
    df = _with_click_files(df, naming.stem(_text("bpm"), "bpm", F.col("_click.name")))
    return _finish(df, "tempos", row_id, is_silent, offset_time)


def time_signatures(base_ids, signatures: Sequence[tuple[int, int]] = fv.TIME_SIGNATURES,
                    reverb_levels: int = len(fv.REVERB_VALUES), configs: Sequence = fv.CLICK_CONFIGS,
                    offsets: int = fv.SIGNATURE_OFFSETS, bpm: int = fv.SIGNATURE_BPM, row_id: str = "row_id",
                    is_silent: Column | None = None, offset_time: Column | None = None) -> DataFrame:
    df = grid.with_ordinals(base_ids, row_id, _s=len(signatures), reverb_level=reverb_levels, _c=len(configs))
    df = df.withColumns({
        "_sig": dims.pick_record(signatures, ("beats", "division"), F.col("_s")),
        "_click": _click(configs, "_c"),
        "bpm": F.lit(bpm),
    })
    beats, division = F.col("_sig.beats"), F.col("_sig.division")
    df = df.withColumns({
        "time_signature": naming.tuple_text(F.array(beats, division)),
        "time_signature_beats": beats,
        "time_signature_subdivision": division,
        "is_compound": pitch.is_compound(beats, division).cast("int"),
    })
    df = grid.fan_out(df, row_id, offsets)
    stem = naming.stem(
        beats.cast("string"), division.cast("string"), _text("bpm"), "bpm", F.col("_click.name"),
        "reverb", "level", _text("reverb_level"),
    )
    df = _with_click_files(df, stem)
    return _finish(df, "time_signatures", row_id, is_silent, offset_time)


def grid_sizes() -> dict[str, list[int]]:
    """Sizes of the full grids; click grids list their base tracks, before the fan-out."""
    n = len(dims.pitched_instrument_rows())
    return {
        "notes": [fv.NOTE_COUNT, n],
        "intervals": [len(INTERVALS), len(fv.INTERVAL_STYLES), n],
        "scales": [len(SCALES), len(fv.SCALE_STYLES), n],
        "chords": [len(CHORDS), len(fv.INVERSIONS), n],
        "chord_progressions": [len(KEYS), len(fv.PROGRESSIONS), n],
        "tempos": [len(BPMS), len(fv.CLICK_CONFIGS)],
        "time_signatures": [len(fv.TIME_SIGNATURES), len(fv.REVERB_VALUES), len(fv.CLICK_CONFIGS)],
    }


BUILDERS = {
    "notes": notes,
    "intervals": intervals,
    "scales": scales,
    "chords": chords,
    "chord_progressions": progressions,
    "tempos": tempos,
    "time_signatures": time_signatures,
}


def full_table(spark: SparkSession, dataset: str) -> DataFrame:
    """The canned dataset with its full grid."""
    return BUILDERS[dataset](grid.grid_ids(spark, grid_sizes()[dataset]))


def with_events(df: DataFrame, dataset: str) -> DataFrame:
    """Add the note events of a label row, for the five pitched datasets."""
    if dataset == "notes":
        return df.withColumn("events", sequences.repeated(F.array(F.col("midi_note_val"))))
    if dataset == "intervals":
        pattern = sequences.interval_pattern(F.col("midi_note_val"), F.col("interval"), F.col("play_style"))
        return df.withColumn("events", pattern)
    if dataset == "scales":
        tonic = pitch.tonic_note(pitch.pitch_class_of(F.col("root_note_name")))
        return df.withColumn(
            "events", sequences.scale_pattern(tonic, pitch.mode_offsets(F.col("mode")), F.col("play_style"))
        )
    if dataset == "chords":
        with_chord = theory.join_named_chord(
            df, "root_note_pitch_class", "chord_type", "inversion", name="_chord"
        )
        return with_chord.withColumn("events", sequences.repeated(F.col("_chord.notes"))).drop("_chord")
    if dataset == "chord_progressions":
        mode = F.split_part("chord_progression", F.lit("-"), F.lit(1))
        degrees = F.transform(
            F.split(F.regexp_extract("chord_progression", r"\((.*)\)", 1), ", "), lambda d: d.cast("int")
        )
        chords_ = theory.progression_chords(F.col("key_note_pitch_class"), pitch.mode_offsets(mode), degrees)
        return df.withColumn("events", sequences.chain(chords_))
    raise ValueError(f"{dataset} has no note events")


def with_clicks(df: DataFrame, dataset: str) -> DataFrame:
    """Add the click messages of a tempo or time-signature row."""
    configs = literal_records(fv.CLICK_CONFIGS, CLICK_FIELDS)
    click = F.filter(configs, lambda c: c["name"] == F.col("click_config_name"))[0]
    if dataset == "tempos":
        beats, division, reverb = F.lit(4), F.lit(4), F.lit(0)
        total = pitch.tempo_beats(F.col("bpm"))
    elif dataset == "time_signatures":
        beats, division = F.col("time_signature_beats"), F.col("time_signature_subdivision")
        reverb, total = F.col("reverb_level"), pitch.signature_beats(division, F.col("bpm"))
    else:
        raise ValueError(f"{dataset} has no click track")
    return df.withColumn("_click", click).withColumn(
        "messages", sequences.click_messages(beats, division, total, F.col("_click"), reverb)
    ).drop("_click")

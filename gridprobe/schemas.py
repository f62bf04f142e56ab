"""Table schemas, as DDL text."""

_INSTRUMENT = "midi_program_num INT, midi_program_name STRING, midi_category STRING"
_FILES = "midi_file_path STRING, synth_file_path STRING, synth_soundfont STRING, is_silent BOOLEAN"
_OFFSET_FILES = "midi_file_path STRING, synth_file_path STRING, offset_file_path STRING, offset_time DOUBLE"

DATASETS = {
    "notes": "row_id BIGINT, root_note_name STRING, root_note_pitch_class INT, octave INT, "
    f"root_note_is_accidental BOOLEAN, register INT, midi_note_val INT, {_INSTRUMENT}, {_FILES}",
    "intervals": "row_id BIGINT, root_note_name STRING, root_note_pitch_class INT, interval INT, "
    f"play_style INT, play_style_name STRING, midi_note_val INT, {_INSTRUMENT}, {_FILES}",
    "scales": "row_id BIGINT, root_note_name STRING, mode STRING, play_style INT, play_style_name STRING, "
    f"{_INSTRUMENT}, {_FILES}",
    "chords": "row_id BIGINT, root_note_name STRING, chord_type STRING, inversion STRING, "
    f"root_note_is_accidental BOOLEAN, root_note_pitch_class INT, {_INSTRUMENT}, {_FILES}",
    "chord_progressions": "row_id BIGINT, key_note_name STRING, key_note_pitch_class INT, "
    f"chord_progression STRING, {_INSTRUMENT}, {_FILES}",
    "tempos": "row_id BIGINT, bpm INT, click_config_name STRING, midi_program_num INT, "
    f"{_OFFSET_FILES}, synth_soundfont STRING, is_silent BOOLEAN",
    "time_signatures": "row_id BIGINT, time_signature STRING, time_signature_beats INT, "
    "time_signature_subdivision INT, is_compound INT, bpm INT, click_config_name STRING, midi_program_num INT, "
    f"{_OFFSET_FILES}, synth_soundfont STRING, reverb_level INT, is_silent BOOLEAN",
}

MODEL_CONFIG = "dataset STRING, model_hash STRING, config STRING"
EMBEDDING = "dataset STRING, model_hash STRING, layer INT, row_id BIGINT, embedding ARRAY<FLOAT>"
SHARD_STATUS = "dataset STRING, model_hash STRING, shard INT, status STRING, message STRING, ts TIMESTAMP, run STRING"
METRICS = "uid STRING, step INT, split STRING, metric STRING, value DOUBLE"


def columns(name: str) -> list[str]:
    """Column names of a dataset table, in order."""
    return [part.split()[0] for part in DATASETS[name].split(", ")]

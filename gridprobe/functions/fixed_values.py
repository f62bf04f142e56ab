"""Names, tables and constants that results depend on, stated as plain text."""

# The 128 General MIDI programs, in program order, eight to a category.
INSTRUMENT_BLOCKS = (
    ("Piano Timbres", (
        "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano",
        "Rhodes Piano", "Chorused Piano", "Harpsichord", "Clavinet")),
    ("Chromatic Percussion", (
        "Celesta", "Glockenspiel", "Music Box", "Vibraphone",
        "Marimba", "Xylophone", "Tubular Bells", "Dulcimer")),
    ("Organ Timbres", (
        "Hammond Organ", "Percussive Organ", "Rock Organ", "Church Organ",
        "Reed Organ", "Accordion", "Harmonica", "Tango Accordion")),
    ("Guitar Timbres", (
        "Acoustic Nylon Guitar", "Acoustic Steel Guitar", "Electric Jazz Guitar", "Electric Clean Guitar",
        "Electric Muted Guitar", "Overdriven Guitar", "Distortion Guitar", "Guitar Harmonics")),
    ("Bass Timbres", (
        "Acoustic Bass", "Fingered Electric Bass", "Plucked Electric Bass", "Fretless Bass",
        "Slap Bass 1", "Slap Bass 2", "Synth Bass 1", "Synth Bass 2")),
    ("String Timbres", (
        "Violin", "Viola", "Cello", "Contrabass",
        "Tremolo Strings", "Pizzicato Strings", "Orchestral Harp", "Timpani")),
    ("Ensemble Timbres", (
        "String Ensemble 1", "String Ensemble 2", "Synth Strings 1", "Synth Strings 2",
        'Choir "Aah"', 'Choir "Ooh"', "Synth Voice", "Orchestral Hit")),
    ("Brass Timbres", (
        "Trumpet", "Trombone", "Tuba", "Muted Trumpet",
        "French Horn", "Brass Section", "Synth Brass 1", "Synth Brass 2")),
    ("Reed Timbres", (
        "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax",
        "Oboe", "English Horn", "Bassoon", "Clarinet")),
    ("Pipe Timbres", (
        "Piccolo", "Flute", "Recorder", "Pan Flute",
        "Bottle Blow", "Shakuhachi", "Whistle", "Ocarina")),
    ("Synth Lead", (
        "Square Wave Lead", "Sawtooth Wave Lead", "Calliope Lead", "Chiff Lead",
        "Charang Lead", "Voice Lead", "Fifths Lead", "Bass Lead")),
    ("Synth Pad", (
        "New Age Pad", "Warm Pad", "Polysynth Pad", "Choir Pad",
        "Bowed Pad", "Metallic Pad", "Halo Pad", "Sweep Pad")),
    ("Synth Effects", (
        "Rain Effect", "Soundtrack Effect", "Crystal Effect", "Atmosphere Effect",
        "Brightness Effect", "Goblins Effect", "Echoes Effect", "Sci-Fi Effect")),
    ("Ethnic Timbres", (
        "Sitar", "Banjo", "Shamisen", "Koto",
        "Kalimba", "Bagpipe", "Fiddle", "Shanai")),
    ("Sound Effects", (
        "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock",
        "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal")),
    ("Sound Effects", (
        "Guitar Fret Noise", "Breath Noise", "Seashore", "Bird Tweet",
        "Telephone Ring", "Helicopter", "Applause", "Gun Shot")),
)

# Instruments left out of the pitched datasets.
ATONAL_CATEGORIES = ("Synth Effects", "Sound Effects")
POLYPHONIC_PROGRAMS = (8, 9, 14, 21, 23, 47, 86)
ARTICULATE_PROGRAMS = (22, 31, 55, 77, 78)

# Semitone offsets of each mode from its root.
MODE_OFFSETS = {
    "aeolian": (0, 2, 3, 5, 7, 8, 10),
    "dorian": (0, 2, 3, 5, 7, 9, 10),
    "harmonicMinor": (0, 2, 3, 5, 7, 8, 11),
    "ionian": (0, 2, 4, 5, 7, 9, 11),
    "locrian": (0, 1, 3, 5, 6, 8, 10),
    "lydian": (0, 2, 4, 6, 7, 9, 11),
    "major": (0, 2, 4, 5, 7, 9, 11),
    "minor": (0, 2, 3, 5, 7, 8, 10),
    "mixolydian": (0, 2, 4, 5, 7, 9, 10),
    "phrygian": (0, 1, 3, 5, 7, 8, 10),
    "phrygianDominant": (0, 1, 4, 5, 7, 8, 10),
}

# The modes of the scale dataset, in grid order.
SCALE_MODES = ("ionian", "dorian", "phrygian", "lydian", "mixolydian", "aeolian", "locrian")

# Note spellings.
SHARP_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
ENHARMONIC_NAMES = (
    ("C",), ("C#", "Db"), ("D",), ("D#", "Eb"), ("E",), ("F",),
    ("F#", "Gb"), ("G",), ("G#", "Ab"), ("A",), ("A#", "Bb"), ("B",),
)
PITCH_CLASS_OF_NAME = {
    "C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "E#": 5, "F": 5,
    "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11,
}
MIDDLE_C = 60

# How a scale-degree accidental moves a note. Only the first character of the
# accidental is looked up, so a double flat counts as a flat.
ACCIDENTAL_SHIFT = {"b": -1, "#": 1}

# Chord sizes, chord qualities by (third, fifth) in semitones, and name parts.
CHORD_SIZE = {5: 3, 7: 4, 9: 5, 11: 6, 13: 6}
CHORD_QUALITY = {(4, 7): "Maj", (3, 7): "m", (3, 6): "d", (4, 8): "A"}
CHORD_SUFFIX = {5: "", 7: "7", 9: "9", 11: "11", 13: "13"}

# Named chords as (name, mode, scale degree, chord type, root shift in semitones).
CHORD_RECIPES = (
    ("major", "ionian", 1, 5, 0),
    ("minor", "aeolian", 1, 5, 0),
    ("aug", "harmonicMinor", 3, 5, -3),
    ("dim", "locrian", 1, 5, 0),
    ("dom7", "mixolydian", 1, 7, 0),
)
CHORD_KINDS = ("major", "minor", "aug", "dim")
INVERSIONS = (None, "6", "64")

# The chord progressions as (mode, scale degrees), in grid order.
PROGRESSIONS = (
    ("ionian", (1, 4, 5, 1)), ("ionian", (1, 4, 6, 5)), ("ionian", (1, 5, 6, 4)), ("ionian", (1, 6, 4, 5)),
    ("ionian", (2, 5, 1, 6)), ("ionian", (4, 1, 5, 6)), ("ionian", (4, 5, 3, 6)), ("ionian", (5, 4, 1, 5)),
    ("ionian", (5, 6, 4, 1)), ("ionian", (6, 4, 1, 5)),
    ("aeolian", (1, 2, 5, 1)), ("aeolian", (1, 3, 4, 1)), ("aeolian", (1, 4, 5, 1)), ("aeolian", (1, 6, 3, 7)),
    ("aeolian", (1, 6, 7, 1)), ("aeolian", (1, 6, 7, 3)), ("aeolian", (1, 7, 6, 4)), ("aeolian", (4, 7, 1, 1)),
    ("aeolian", (7, 6, 7, 1)),
)

# Grid domains of the remaining datasets.
NOTE_COUNT = 108
REGISTER_CUTS = (3, 6, 9)
INTERVAL_BASES = tuple(range(60, 72))
INTERVAL_SIZES = tuple(range(1, 13))
INTERVAL_STYLES = ("UP", "DOWN", "UNISON")
SCALE_STYLES = ("UP", "DOWN")
SLOWEST_BPM, FASTEST_BPM = 50, 210
TEMPO_OFFSETS = 5
TIME_SIGNATURES = ((2, 2), (2, 4), (3, 4), (3, 8), (4, 4), (6, 8), (9, 8), (12, 8))
REVERB_VALUES = {0: 0, 1: 63, 2: 127}
SIGNATURE_OFFSETS = 10
SIGNATURE_BPM = 120
SOUNDFONT = "TimGM6mb.sf2"

# Click sounds as (channel, program, downbeat note, offbeat note, name, velocities).
CLICK_CONFIGS = (
    (9, 0, 37, 31, "default", 100, 75),
    (2, 115, 37, 31, "woodblock_dark", 100, 75),
    (2, 115, 52, 48, "woodblock_light", 100, 75),
    (2, 116, 52, 48, "taiko", 100, 75),
    (2, 118, 52, 48, "synth_drum", 100, 75),
)

# Message encoding.
TICKS_PER_BEAT = 480
NOTE_VELOCITY = 64
REST_NOTE = 64
REVERB_CONTROL = 91
SAMPLE_RATE = 44100

# Models with their number of layers (None = one vector per sample).
MODEL_LAYERS = {
    "JUKEBOX": 72,
    "MUSICGEN_AUDIO_ENCODER": None,
    "MUSICGEN_DECODER_LM_S": 24,
    "MUSICGEN_DECODER_LM_M": 48,
    "MUSICGEN_DECODER_LM_L": 48,
    "MELSPEC": None,
    "CHROMA": None,
    "MFCC": None,
    "HANDCRAFT": None,
}
DECODER_FAMILY = "MUSICGEN_DECODER"

# Probe targets per concept as (classes, column); the first one is probed.
CONCEPT_LABELS = {
    "chord_progressions": ((19, "chord_progression"), (12, "key_note_name")),
    "chords": ((4, "chord_type"), (3, "inversion"), (12, "root_note_name")),
    "scales": ((7, "mode"), (12, "root_note_name")),
    "intervals": ((12, "interval"), (12, "root_note_name")),
    "notes": ((12, "root_note_pitch_class"), (9, "octave")),
    "time_signatures": ((8, "time_signature"), (6, "time_signature_beats"), (3, "time_signature_subdivision")),
    "tempos": ((161, "bpm"),),
}
REGRESSION_CONCEPTS = ("tempos",)
LARGE_CONCEPTS = ("intervals", "chord_progressions")

# The hyper-parameter grid and the four sweeps.
HYPER_GRID = {
    "data_standardization": (False, True),
    "hidden_layer_sizes": ((), (512,)),
    "batch_size": (64, 256),
    "learning_rate": (1e-5, 1e-4, 1e-3),
    "dropout_p": (0.25, 0.5, 0.75),
    "l2_weight_decay": (None, 1e-4, 1e-3),
}
SWEEP_SPACES = {
    "handcrafted": (("CHROMA", "MELSPEC", "MFCC", "HANDCRAFT"), ("L",), 1, True),
    "encoder": (("MUSICGEN_AUDIO_ENCODER",), ("L",), 1, True),
    "jukebox": (("JUKEBOX",), ("L",), 72, False),
    "musicgen": (("MUSICGEN_DECODER",), ("L", "M", "S"), 49, False),
}

# Defaults and required fields of a probe configuration.
PROBE_DEFAULTS = {
    "model_hash": None,
    "dataset": None,
    "dataset_embeddings_label_column_name": None,
    "data_standardization": True,
    "hidden_layer_sizes": [],
    "batch_size": 64,
    "learning_rate": 1e-3,
    "dropout_p": 0.5,
    "l2_weight_decay": None,
    "max_num_epochs": None,
    "early_stopping_metric": "primary",
    "early_stopping": True,
    "early_stopping_eval_frequency": 8,
    "early_stopping_boredom": 256,
    "seed": 0,
    "num_outputs": None,
    "load_embeddings_in_memory": False,
}
PROBE_REQUIRED = ("dataset", "dataset_embeddings_label_column_name", "model_hash", "num_outputs")

# Job settings.
STALE_SHARD_HOURS = 6
SAMPLES_PER_SHARD = 300

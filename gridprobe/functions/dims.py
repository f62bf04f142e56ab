"""Small dimension tables, built from the fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.functions import fixed_values as fv
from gridprobe.functions.literals import literal, literal_records

INSTRUMENT_SCHEMA = "category string, program int, name string"


def instrument_rows() -> list[tuple[str, int, str]]:
    names = [(category, name) for category, block in fv.INSTRUMENT_BLOCKS for name in block]
    return [(category, program, name) for program, (category, name) in enumerate(names)]


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(instrument_rows(), INSTRUMENT_SCHEMA)


def pitched_instrument_rows() -> list[tuple[str, int, str]]:
    """The 92 programs that carry a clear pitch."""
    dropped = set(fv.POLYPHONIC_PROGRAMS) | set(fv.ARTICULATE_PROGRAMS)
    return [r for r in instrument_rows() if r[0] not in fv.ATONAL_CATEGORIES and r[1] not in dropped]


def modes(spark: SparkSession) -> DataFrame:
    rows = [(name, list(offsets)) for name, offsets in fv.MODE_OFFSETS.items()]
    return spark.createDataFrame(rows, "mode string, offsets array<int>")


def chord_recipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fv.CHORD_RECIPES), "kind string, mode string, degree int, chord_type int, root_shift int"
    )


def click_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fv.CLICK_CONFIGS),
        "channel int, midi_program_num int, downbeat_note int, offbeat_note int, name string, "
        "downbeat_velocity int, offbeat_velocity int",
    )


def models(spark: SparkSession) -> DataFrame:
    rows = list(fv.MODEL_LAYERS.items())
    return spark.createDataFrame(rows, "model_name string, max_layers int")


def concept_labels(spark: SparkSession) -> DataFrame:
    """Probe targets; ordinal 0 is the one a sweep probes."""
    rows = [
        (concept, ordinal, classes, column)
        for concept, targets in fv.CONCEPT_LABELS.items()
        for ordinal, (classes, column) in enumerate(targets)
    ]
    return spark.createDataFrame(rows, "concept string, ordinal int, num_classes int, column string")


def excluded_programs(spark: SparkSession) -> DataFrame:
    rows = [(p,) for p in fv.POLYPHONIC_PROGRAMS + fv.ARTICULATE_PROGRAMS]
    return spark.createDataFrame(rows, "program int")


def pick(values, ordinal):
    """The entry of a short literal list at a 0-based ordinal column."""
    return F.element_at(literal(values), (ordinal + 1).cast("int"))


def pick_record(records, fields, ordinal):
    """Like ``pick`` for records: a struct column with the given field names."""
    return F.element_at(literal_records(records, fields), (ordinal + 1).cast("int"))

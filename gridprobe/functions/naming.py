"""File names and text labels of the datasets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def stem(*parts) -> Column:
    """Parts joined by ``_``; none of them may be null."""
    return F.concat_ws("_", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def with_suffix(name: Column, suffix: str) -> Column:
    return F.concat(name, F.lit(suffix))


def tuple_text(values: Column) -> Column:
    """``(1, 4, 5, 1)`` from an array of numbers."""
    return F.concat(F.lit("("), F.concat_ws(", ", F.transform(values, lambda v: v.cast("string"))), F.lit(")"))


def dashed(values: Column) -> Column:
    return F.concat_ws("-", F.transform(values, lambda v: v.cast("string")))


def audio_path(offset_path: Column, synth_path: Column) -> Column:
    """The cropped file where there is one, else the full one."""
    return F.coalesce(F.nullif(offset_path, F.lit("")), synth_path)

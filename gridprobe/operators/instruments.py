"""Instrument filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import dims
from gridprobe.functions import fixed_values as fv
from gridprobe.operators.runs import first_of_each_stretch


def select_instruments(
    df: DataFrame,
    ignore_atonal: bool = False,
    ignore_polyphonic: bool = False,
    ignore_highly_articulate: bool = False,
    take_only_first_category: bool = False,
    category: str = "category",
    program: str = "program",
) -> DataFrame:
    """Filter an instrument table; the last option keeps the first row of each run of a category."""
    if ignore_atonal:
        df = df.filter(~F.col(category).isin(*fv.ATONAL_CATEGORIES))
    if ignore_polyphonic:
        df = df.filter(~F.col(program).isin(*fv.POLYPHONIC_PROGRAMS))
    if ignore_highly_articulate:
        df = df.filter(~F.col(program).isin(*fv.ARTICULATE_PROGRAMS))
    if take_only_first_category:
        df = first_of_each_stretch(df, program, category)
    return df


def drop_excluded(df: DataFrame, program: str = "program") -> DataFrame:
    """Remove the excluded programs with an anti join against their 12-row dimension."""
    excluded = dims.excluded_programs(df.sparkSession).withColumnRenamed("program", program)
    return df.join(F.broadcast(excluded), program, "left_anti")

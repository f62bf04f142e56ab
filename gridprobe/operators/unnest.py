"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, *keep: str, index: str = "i", value: str = "x") -> DataFrame:
    """One row per element with its 0-based place; rows without elements vanish.

    The outer form with a filter behind it gives the rows of a plain explode. A plain explode makes the
    optimiser test the array for elements first, which computes a derived array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(index, value))
    return rows.filter(F.col(index).isNotNull())

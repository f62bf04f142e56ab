"""Broadcasting behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table of this many rows may be listed on the driver and sent to every executor.
SMALL_ROWS = 10_000


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The table as a broadcast literal if it has at most ``limit`` rows, else the table itself.

    For results whose size the planner cannot know, such as aggregates over a large table. Without the
    check it would shuffle the other side of the join before it finds out. The table is computed once
    if it is small; no more than ``limit`` rows and one reach the driver.
    """
    bound = SMALL_ROWS if limit is None else limit
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))

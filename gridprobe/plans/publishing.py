"""Publishing a dataset, with what was silent and what was rejected counted on the way."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import signal
from gridprobe.sources import sinks


def long_enough(n_samples: Column, rate: Column | int, minimum_seconds: float) -> Column:
    """Whether a row has the minimum duration; one of unknown length has not."""
    return F.coalesce(signal.seconds(n_samples, rate) >= minimum_seconds, F.lit(False))


def publish_dataset(
    df: DataFrame, path: str, fits: Column | None = None, silent: str | None = "is_silent", row_id: str | None = "row_id",
) -> dict[str, int]:
    """Write a dataset once and return how many rows came (n), were written (n_kept), were rejected because ``fits``
    does not hold for them or is NULL (n_rejected), and were written and are silent (n_silent).

    All four are observed on the one pass that makes the rows, and silent or rejected rows give a warning. Silent rows
    are kept: whoever reads the table decides. A NULL flag is not silent.
    """
    sound = F.coalesce(fits, F.lit(False)) if fits is not None else F.lit(True)
    quiet = F.coalesce(F.col(silent).cast("boolean"), F.lit(False)) if silent else F.lit(False)
    counts = sinks.publish(
        df, path, row_id=row_id, where=sound if fits is not None else None, counts={
            "n": F.count(F.lit(1)), "n_kept": F.count_if(sound), "n_rejected": F.count_if(~sound),
            "n_silent": F.count_if(sound & quiet),
        },
    )
    if counts["n_silent"]:
        warnings.warn(f"{counts['n_silent']} of {counts['n_kept']} samples at {path} are silent", UserWarning, stacklevel=2)
    if counts["n_rejected"]:
        warnings.warn(f"{counts['n_rejected']} of {counts['n']} samples were rejected and are not at {path}", UserWarning, stacklevel=2)
    return counts

"""Row-local vector functions for probes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridprobe.functions import signal
from gridprobe.functions.binding import let


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return let(values, lambda wide: (F.array_position(wide, F.array_max(wide)) - 1).cast("int"))


def is_blank(values: Column) -> Column:
    """All zero, which the embedding store reads as not yet written."""
    return ~F.exists(values, lambda x: x != 0)


def cross_entropy(logits: Column, code: Column) -> Column:
    """Softmax cross-entropy of one row, shifted by the maximum so that it cannot overflow."""

    def loss(wide: Column) -> Column:
        def above(top: Column) -> Column:
            spread = F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
            return F.log(spread) + top - F.element_at(wide, (code + 1).cast("int"))

        return let(F.array_max(wide), above)

    return let(signal.widen(logits), loss)


def one_hot(code: Column, classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == code, 1.0).otherwise(0.0).cast("float")
    )


def standardised(values: Column, means: Column, deviations: Column) -> Column:
    """(x - mean) / deviation per dimension, where a zero deviation counts as one."""
    centred = F.zip_with(signal.widen(values), means, lambda x, m: x - m)
    return F.zip_with(centred, deviations, lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))

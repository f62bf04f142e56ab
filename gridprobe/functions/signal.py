"""Row-local operations on sample arrays and frame matrices.

Every function works inside one row, so none of them shuffles. Elements are widened to DOUBLE
before arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridprobe.functions.binding import let


def widen(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation, in two passes over the row."""

    def spread(v: Column, centre: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))
        return F.sqrt(F.try_divide(squares, F.size(v)))

    return let(values, lambda v: let(mean(v), lambda centre: spread(v, centre)))


def is_silent(samples: Column) -> Column:
    """True if every sample is exactly zero; an empty array is silent."""
    return F.forall(samples, lambda x: x == 0)


def _mean_rows(matrix: Column) -> Column:
    """Mean over the outer array of equally long inner arrays."""

    def pooled(m: Column) -> Column:
        summed = F.aggregate(
            F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))),
            widen(m[0]),
            lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b),
        )
        return F.transform(summed, lambda x: x / F.size(m))

    return let(matrix, pooled)


def downmix(channels: Column) -> Column:
    """Mean over channels, from an array of equally long channels."""
    return _mean_rows(channels)


def peak_normalised(samples: Column) -> Column:
    """Samples divided by the largest magnitude; silence is left alone."""

    def scaled(wide: Column) -> Column:
        peak = F.array_max(F.transform(wide, F.abs))
        return let(peak, lambda p: F.when(p > 0, F.transform(wide, lambda x: x / p)).otherwise(wide))

    return let(widen(samples), scaled)


def seconds(n_samples: Column, rate: Column | int) -> Column:
    return n_samples / (rate if isinstance(rate, Column) else F.lit(rate))


def long_enough(samples: Column, rate, minimum_seconds: float) -> Column:
    return seconds(F.size(samples), rate) >= minimum_seconds


def checked(samples: Column, fits: Column, what: str) -> Column:
    return F.when(fits, samples).otherwise(
        F.raise_error(F.concat(F.lit(f"{what}: only "), F.size(samples).cast("string"), F.lit(" samples")))
    )


def head_trim(samples: Column, length: int) -> Column:
    """(kept, removed): the first ``length`` samples; longer targets are an error."""
    usable = checked(samples, F.size(samples) >= length, f"cannot trim to {length}")
    return F.struct(
        F.slice(usable, 1, length).alias("kept"), (F.size(samples) - length).alias("removed")
    )


def crop_start(samples: Column, length: int, unit: Column) -> Column:
    """Start of a crop, uniform over the positions that fit."""
    return F.floor(unit * (F.size(samples) - length)).cast("int")


def random_crop(samples: Column, length: int, unit: Column) -> Column:
    """(start, kept): the target must be strictly shorter than the source."""
    usable = checked(samples, F.size(samples) > length, f"cannot crop to {length}")
    start = crop_start(samples, length, unit)
    return F.struct(start.alias("start"), F.slice(usable, start + 1, F.lit(length)).alias("kept"))


def frames_by_feature(values: Column, features: int, frames: int) -> Column:
    """A flat feature-major array as an array of per-feature frame arrays."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(features - 1)), lambda i: widen(F.slice(values, i * frames + 1, frames))
    )


def step_difference(values: Column) -> Column:

    def stepped(v: Column) -> Column:
        rest = F.greatest(F.size(v) - 1, F.lit(0))
        return F.zip_with(F.slice(v, 2, rest), F.slice(v, 1, rest), lambda a, b: a - b)

    return let(values, stepped)


def difference(values: Column, order: int) -> Column:
    for _ in range(order):
        values = step_difference(values)
    return values


def moments(matrix: Column) -> Column:
    """Mean and deviation over time of differences of order 0, 1 and 2, block by block."""
    blocks, rows = [], matrix
    for order in range(3):
        if order:
            rows = F.transform(rows, step_difference)
        blocks += [F.transform(rows, mean), F.transform(rows, deviation)]
    return F.concat(*blocks)


def mean_over_time(matrix: Column) -> Column:
    """Column means of an array of equally long frames."""
    return _mean_rows(matrix)


def mean_over_two_axes(cube: Column) -> Column:
    """Mean over the two inner axes, one value per outer entry."""
    return F.transform(cube, lambda plane: mean(F.flatten(F.transform(plane, widen))))

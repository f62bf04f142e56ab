"""Hyper-parameter grids: a sweep row is decoded from its id."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.functions import dims
from gridprobe.functions import fixed_values as fv
from gridprobe.functions.literals import literal
from gridprobe.operators import grid


def sweep_space(sweep: str) -> dict[str, tuple]:
    """Parameter values of a named sweep, in grid order."""
    families, sizes, layers, with_hyper = fv.SWEEP_SPACES[sweep]
    space = {
        "model_type": families,
        "model_size": sizes,
        "model_layer": tuple(range(layers)),
        "concept": tuple(fv.CONCEPT_LABELS),
    }
    return {**space, **(fv.HYPER_GRID if with_hyper else {})}


def sweep_size(sweep: str) -> int:
    return prod(len(v) for v in sweep_space(sweep).values())


def _value(values: tuple, ordinal: Column) -> Column:
    if isinstance(values[0], tuple):
        return F.element_at(literal(values).cast("array<array<int>>"), ordinal + 1)
    return dims.pick(values, ordinal)


def expand_space(ids: DataFrame, space: dict[str, tuple], row_id: str = "config_id") -> DataFrame:
    """Add one column per parameter; ids past the grid start over."""
    places = grid.ordinals(F.col(row_id), [len(v) for v in space.values()])
    return ids.withColumns({n: _value(v, p) for (n, v), p in zip(space.items(), places)})


def sweep(spark: SparkSession, name: str) -> DataFrame:
    """The full grid of a named sweep."""
    return expand_space(grid.grid_ids(spark, [sweep_size(name)], "config_id"), sweep_space(name))

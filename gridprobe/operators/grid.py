"""Dense-id cross products of ordered dimensions, without joining all pairs.

A grid row is its id: the id decodes into one ordinal per dimension by mixed radix, the last
dimension running fastest. Ids come from ``spark.range``, which every task fills on its own, or from
any table that carries ids.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridprobe.operators.ranks import with_dense_index
from gridprobe.operators.small import SMALL_ROWS as SHORT_DIMENSION


def floor_div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def ordinals(row_id: Column, sizes: list[int]) -> list[Column]:
    """One 0-based ordinal per dimension; ids beyond the grid wrap around."""
    columns, stride = [], 1
    for size in reversed(sizes):
        columns.append((floor_div(row_id, stride) % size).cast("int"))
        stride *= size
    return columns[::-1]


def with_ordinals(df: DataFrame, row_id: str, **sizes: int) -> DataFrame:
    decoded = ordinals(F.col(row_id), list(sizes.values()))
    return df.withColumns(dict(zip(sizes, decoded)))


def grid_ids(spark: SparkSession, sizes: list[int], name: str = "row_id") -> DataFrame:
    return spark.range(prod(sizes)).withColumnRenamed("id", name)


def fan_out(df: DataFrame, row_id: str, copies: int, index: str = "offset_index") -> DataFrame:
    """``copies`` rows per input row with ids ``row_id * copies + index``."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
        row_id, F.col(row_id) * copies + F.col(index)
    )


def _with_ordinal(dim: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """A dimension with its dense ordinals, and its size.

    A short dimension is listed on the driver and may be broadcast. A long one is numbered by range
    shuffle and joined without a hint.
    """
    rows = dim.orderBy(*order).limit(SHORT_DIMENSION + 1).collect()
    if len(rows) <= SHORT_DIMENSION:
        schema = T.StructType([*dim.schema.fields, T.StructField(name, T.IntegerType())])
        listed = dim.sparkSession.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema)
        return F.broadcast(listed), len(rows)
    numbered = with_dense_index(dim, *order, name=name)
    return numbered.withColumn(name, F.col(name).cast("int")), numbered.count()


def dense_grid(spark: SparkSession, dims: list[tuple[DataFrame, list[str]]], name: str = "row_id") -> DataFrame:
    """The grid over dimension tables, each given with the columns that order it uniquely."""
    indexed = [_with_ordinal(dim, order, f"_o{i}") for i, (dim, order) in enumerate(dims)]
    sizes = [size for _, size in indexed]
    grid = grid_ids(spark, sizes, name)
    grid = grid.withColumns({f"_o{i}": c for i, c in enumerate(ordinals(F.col(name), sizes))})
    for i, (dim, _) in enumerate(indexed):
        grid = grid.join(dim, f"_o{i}")
    return grid.drop(*[f"_o{i}" for i in range(len(dims))])

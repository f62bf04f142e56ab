"""Pooling of feature frames and layer states into vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import signal
from gridprobe.operators.unnest import unnest


def moment_vectors(df: DataFrame, features: str, frames_shape: tuple[int, int], name: str = "embedding") -> DataFrame:
    """Add the six moment blocks of a flat feature-major array; 6 x features values."""
    n_features, n_frames = frames_shape
    matrix = signal.frames_by_feature(F.col(features), n_features, n_frames)
    return df.withColumn("_m", matrix).withColumn(name, signal.moments(F.col("_m"))).drop("_m")


def concat_features(tables: list[DataFrame], row_id: str, column: str, name: str) -> DataFrame:
    """Join feature tables on the row id and concatenate their vectors in the given order.

    Tables written in row-id buckets join without a shuffle; otherwise each is shuffled once.
    """
    joined = tables[0].select(row_id, F.col(column).alias("_v0"))
    for i, table in enumerate(tables[1:], 1):
        joined = joined.join(table.select(row_id, F.col(column).alias(f"_v{i}")), row_id)
    return joined.select(row_id, F.concat(*[f"_v{i}" for i in range(len(tables))]).alias(name))


def pool_layers(df: DataFrame, states: str, *keep: str, layer: int | None = None) -> DataFrame:
    """Mean over time of each layer's frames: one row per layer, or only the wanted layer.

    ``states`` is array<layer> of array<frame> of array<value>.
    """
    if layer is not None:
        one = F.col(states)[layer]
        return df.select(*keep, F.lit(layer).alias("layer"), signal.mean_over_time(one).alias("embedding"))
    layers = unnest(df, states, *keep, index="layer", value="_frames")
    return layers.select(*keep, "layer", signal.mean_over_time(F.col("_frames")).alias("embedding"))


def pool_long(df: DataFrame, value: str, *group: str) -> DataFrame:
    """Mean per group of a long table of single values, folded inside each task first."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"))


def layer_rows(df: DataFrame, stacked: str, *keep: str) -> DataFrame:
    """A stacked (layers, dim) embedding as one row per layer, the form the store partitions by."""
    return unnest(df, stacked, *keep, index="layer", value="embedding")

"""Exact-size splits and batches, reproducible from a seed and the row id."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.functions.hashing import HASH_SPAN, hash_key
from gridprobe.operators.ranks import before, keys_at_ranks

TRAIN_SHARE = 0.7
TAIL_SHARE = 0.15
HASH_BOUNDS = (0, HASH_SPAN - 1)


def shuffle_split_sizes(n: int, train_share: float = TRAIN_SHARE) -> tuple[int, int, int]:
    """(train, valid, test): train rounds down, and test takes the odd row."""
    train = math.floor(train_share * n)
    valid = (n - train) // 2
    return train, valid, n - train - valid


def shuffle_split(df: DataFrame, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """Add ``split`` by position in a seeded shuffle.

    Only two cut points of the shuffled order are looked up; a row then compares its own key with
    them, so nothing is sorted or moved.
    """
    keyed = df.withColumn("_h", hash_key(seed, F.col(row_id)))

    def cuts(n: int) -> list[int]:
        train, valid, _ = shuffle_split_sizes(n)
        return [train, train + valid]

    n, found = keys_at_ranks(keyed, "_h", row_id, cuts, HASH_BOUNDS)
    first, second = [found.get(rank) for rank in cuts(n)]
    split = (
        F.when(before(F.col("_h"), F.col(row_id), first), "train")
        .when(before(F.col("_h"), F.col(row_id), second), "valid")
        .otherwise("test")
    )
    return keyed.withColumn("split", split).drop("_h")


def extrapolation_split(df: DataFrame, label: str, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """Add ``split``: the middle of the label range trains, the shuffled tails test and validate.

    Rows without a label are in no split.
    """

    def edges(n: int) -> list[int]:
        return [int(n * TAIL_SHARE), int(n * (1 - TAIL_SHARE))]

    n, found = keys_at_ranks(df, label, row_id, edges)
    low, high = edges(n)
    key, tie = F.col(label), F.col(row_id)
    middle = ~before(key, tie, found.get(low)) & before(key, tie, found.get(high))
    keyed = df.withColumn("_h", hash_key(seed, tie)).withColumn("_middle", middle)
    tails = n - (high - low)
    _, halves = keys_at_ranks(keyed.filter(~F.col("_middle")), "_h", row_id, [tails // 2], HASH_BOUNDS)
    split = (
        F.when(key.isNull(), F.lit(None))
        .when(F.col("_middle"), "train")
        .when(before(F.col("_h"), tie, halves.get(tails // 2)), "test")
        .otherwise("valid")
    )
    return keyed.withColumn("split", split).drop("_h", "_middle")


def positional_slice(df: DataFrame, key: str, tie: str, start: int, stop: int) -> DataFrame:
    """Rows at positions start..stop-1 of the order by (key, tie), unsorted."""
    _, found = keys_at_ranks(df, key, tie, [start, stop])
    if start not in found:
        return df.limit(0)
    k, t = F.col(key), F.col(tie)
    return df.filter(~before(k, t, found[start]) & before(k, t, found.get(stop)))


def random_batch(df: DataFrame, size: int, row_id: str = "row_id", seed: int = 0, step: int = 0) -> DataFrame:
    """``min(size, n)`` rows without replacement; a top-k, so only k rows per task survive."""
    key = hash_key(seed, F.lit(step), F.col(row_id))
    return df.withColumn("_h", key).orderBy("_h", row_id).limit(size).drop("_h")

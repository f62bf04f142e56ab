"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.llm.common import release, stage


def _pairs(df: DataFrame) -> DataFrame:
    """Each edge once, as (u, v) with u > v."""
    return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return _pairs(both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return _pairs(moved.union(lowest.select("u", F.col("low").alias("v"))))


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (u, v) of longs; the component is its least node.

    Each round halves the distances at least; rounds go on until the edges stay the same. Minima are
    aggregated before they are shuffled and joined back to the edges, so that no task gathers the
    neighbours of one node. Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    current = stage(_pairs(edges), "edges")
    seen = _print_of(current)
    while seen[0]:
        following = stage(_small_star(_large_star(current)), "edges")
        found = _print_of(following)
        release(current)
        current = following
        if found == seen:
            break
        seen = found
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

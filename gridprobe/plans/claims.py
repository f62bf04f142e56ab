"""Claims on shards, so that runs that overlap in time never extract a sample twice.

A run writes the list of its shards and then draws a ticket: the next number, created under a name that nobody
else can create. A shard belongs to the lowest ticket that is still open and lists it. Whoever draws a ticket sees
every lower one, with its list, and leaves its shards alone; higher ones will do the same. A ticket is closed
when its run has ended; one that has been open for too long counts as lost.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.functions import fixed_values as fv
from gridprobe.sources import sinks

STALE_SECONDS = fv.STALE_SHARD_HOURS * 3600


@dataclass
class Claim:
    spark: SparkSession
    root: str
    run: str
    number: int
    taken: float
    stale_seconds: float

    def check(self) -> None:
        """Fail if the claim has been open for so long that others take it for lost."""
        if time.time() - self.taken >= self.stale_seconds:
            raise RuntimeError(f"run {self.run} has held its shards for too long and may have lost them")

    def close(self) -> None:
        sinks.write_text(self.spark, f"{self.root}/closed/{self.number:012d}", self.run)


def _names(spark: SparkSession, folder: str) -> list[str]:
    """File names in a folder, one per run; none if it is not there."""
    return [r["path"].rsplit("/", 1)[1] for r in sinks.list_paths(spark, f"{folder}/*").collect()]


def shards_of(spark: SparkSession, root: str, run: str) -> DataFrame:
    return spark.read.schema("shard int").parquet(f"{root}/lists/{run}")


def claim(shards: DataFrame, root: str, run: str, stale_seconds: float = STALE_SECONDS) -> tuple[Claim, DataFrame]:
    """Claim the shards (column ``shard``); returns the claim and those that no open lower ticket has.

    ``root`` is one folder per target, that is per dataset, model and layer. Tickets are as many as runs; lists are
    tables, so a run may claim any number of shards.
    """
    spark = shards.sparkSession
    shards.select(F.col("shard").cast("int").alias("shard")).write.parquet(f"{root}/lists/{run}")
    sinks.write_text(spark, f"{root}/waiting/{run}", f"{run} {time.time()}")
    number = max((int(n) for n in _names(spark, f"{root}/tickets")), default=0) + 1
    while not sinks.create_from(spark, f"{root}/waiting/{run}", f"{root}/tickets/{number:012d}"):
        number += 1
    taken = float(sinks.read_text(spark, f"{root}/tickets/{number:012d}").split()[1])
    mine = shards_of(spark, root, run)
    closed = set(_names(spark, f"{root}/closed"))
    for name in sorted(_names(spark, f"{root}/tickets")):
        if int(name) >= number or name in closed:
            continue
        other, since = sinks.read_text(spark, f"{root}/tickets/{name}").split()
        if time.time() - float(since) < stale_seconds:
            mine = mine.join(shards_of(spark, root, other), "shard", "left_anti")
    return Claim(spark, root, run, number, taken, stale_seconds), mine

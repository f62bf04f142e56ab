"""Extraction of vectors as samples arrive, each sample exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridprobe.plans.embedding_job import extract, signals_of
from gridprobe.sources import sinks

# How long ids are kept as state. A sample that comes again later is found in the store.
REMEMBERED = "1 hour"


def stored_ids(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The row ids of a batch that a store has.

    Only the store's ids between the least and the largest of the batch are read, and a small batch is broadcast to
    them, so the store is not shuffled.
    """
    low, high = batch.agg(F.min("row_id"), F.max("row_id")).first()
    if low is None:
        return store.select("row_id").limit(0)
    return signals_of(batch, store.select("row_id").filter(F.col("row_id").between(low, high)))


def extract_stream(
    stream: DataFrame, load: Callable, path: str, checkpoint: str, element: str = "float", remembered: str = REMEMBERED,
) -> StreamingQuery:
    """Append the vectors of new rows to ``path``, in a folder per stream and batch.

    Ids are state for ``remembered`` after their arrival, which takes out what is sent twice in a row; the state holds no
    more than arrives in that time, however long the stream runs. What passes is looked up in the folders of earlier batches and other
    streams, so a sample sent again after any time, or to a stream with a new checkpoint, is not made again. Each batch replaces its own
    folder: replayed after a failure, it sees the same state and the same earlier folders and gives the same rows, once. Two streams that
    run at the same time into one path must not get the same samples. Rows without an id are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The id of the stream lies in its checkpoint, so it stays over restarts.
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        # Read several times below; a lost part is made again from the same state.
        arrived = batch.drop("_arrived").persist()
        try:
            fresh = arrived
            if sinks.list_paths(spark, f"{path}/stream=*/batch_id=*").limit(1).count():
                store = spark.read.schema("row_id long, stream string, batch_id long").parquet(path)
                earlier = store.filter((F.col("stream") != stream_id) | (F.col("batch_id") < batch_id))
                fresh = arrived.join(stored_ids(earlier, arrived), "row_id", "left_anti")
            extract(fresh, load, element=element).write.mode("overwrite").parquet(f"{path}/stream={stream_id}/batch_id={batch_id}")
        finally:
            arrived.unpersist()

    arriving = stream.filter("row_id IS NOT NULL").withColumn("_arrived", F.current_timestamp())
    return (
        arriving.withWatermark("_arrived", remembered).dropDuplicatesWithinWatermark(["row_id"])
        .writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    )

"""Sharded, resumable embedding jobs.

A manifest lists the samples of a run. What is already in the store is taken out with an anti join, the
rest goes through an extractor, and the vectors are appended. Running a job again does only the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import naming, vectors
from gridprobe.functions import fixed_values as fv
from gridprobe.operators import guards, pooling, shards
from gridprobe.plans import claims
from gridprobe.session import pin
from gridprobe.sources import sinks


def build_manifest(
    table: DataFrame, dataset: str | Column, model_name: str | Column, model_hash: str | Column,
    max_samples: int = fv.SAMPLES_PER_SHARD, row_id: str = "row_id", offset: str = "offset_file_path",
    synth: str = "synth_file_path",
) -> DataFrame:
    """One row per sample: its shard, its place, the file to read, and the whole row as details."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    chosen = naming.audio_path(F.col(offset) if offset in table.columns else F.lit(None), F.col(synth))
    return table.select(
        F.col(row_id).alias("row_id"),
        as_column(model_name).alias("model_name"),
        as_column(model_hash).alias("model_config_checksum"),
        as_column(dataset).alias("dataset_name"),
        shards.shard_of(F.col(row_id), max_samples).alias("dataset_shard"),
        chosen.alias("audio_file_path"),
        F.struct(*[F.col(c) for c in table.columns]).alias("details"),
    )


def flat_manifest(manifest: DataFrame) -> DataFrame:
    """Details as dotted columns, the form of a flat file."""
    inner = manifest.schema["details"].dataType.fieldNames()
    return manifest.select(
        *[c for c in manifest.columns if c != "details"],
        *[F.col(f"details.{c}").alias(f"details.{c}") for c in inner],
    )


def shard_rows(manifest: DataFrame, shard: int) -> DataFrame:
    return manifest.filter(F.col("dataset_shard") == shard)


def written(store: DataFrame, column: str = "embedding") -> DataFrame:
    """Row ids with a vector; an all-zero vector counts as not written, as in a preallocated array."""
    return store.filter(~vectors.is_blank(F.col(column))).select("row_id")


def pending(manifest: DataFrame, store: DataFrame, column: str = "embedding") -> DataFrame:
    """Samples still to be extracted, where blank vectors are placeholders."""
    return manifest.join(written(store, column), "row_id", "left_anti")


def missing(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Samples without a row in the store. A job appends rows only when it has made them, so a blank vector
    there is the result for a silent sample and is not made again."""
    return manifest.join(store.select("row_id").distinct(), "row_id", "left_anti")


Extractor = Callable[[list], list]


def extract(
    df: DataFrame, load: Callable[[], Extractor], signal: str = "samples", batch_rows: int = 64,
    element: str = "float", layered: bool = False,
) -> DataFrame:
    """(row_id, embedding) from a user extractor.

    ``load`` runs once per task, so a model is loaded once, and the extractor it returns gets batches
    of sample arrays and gives back one vector each, or with ``layered`` one matrix of layers. A failing
    sample fails the task. ``element`` is the stored type, float or double.
    """
    wanted = df.select("row_id", F.col(signal).cast("array<float>").alias("samples"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = load()
        kind = np.float32 if element == "float" else np.float64

        def lists(values: list, leaf) -> pa.Array:
            """Arrays of the first dimension as Arrow lists, without a Python object per number."""
            offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), leaf(values))

        def flat(values: list) -> pa.Array:
            return pa.array(np.concatenate([np.empty(0, kind), *values]).astype(kind, copy=False))

        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                samples = part.column("samples")
                rows = [samples[i].values.to_numpy(zero_copy_only=False) for i in range(part.num_rows)]
                made = [np.asarray(v, kind) for v in model(rows)]
                inner = (lambda m: lists([layer for v in m for layer in v], flat)) if layered else flat
                yield pa.RecordBatch.from_arrays([part.column("row_id"), lists(made, inner)], ["row_id", "embedding"])

    shape = f"array<array<{element}>>" if layered else f"array<{element}>"
    return wanted.mapInArrow(run, f"row_id bigint, embedding {shape}")


def moment_extractor(n_features: int) -> Callable[[], Extractor]:
    """A loader for the built-in extractor: moments of feature frames and their differences."""

    def load():
        import numpy as np

        def moments(rows: list) -> list:
            out = []
            for flat in rows:
                matrix = np.asarray(flat, dtype=np.float64).reshape(n_features, -1)
                stages = [np.diff(matrix, n=k, axis=1) for k in range(3)]
                out.append(np.concatenate([pool for s in stages for pool in (s.mean(axis=1), s.std(axis=1))]))
            return out

        return moments

    return load


# Row ids up to this many are broadcast: eight megabytes.
BROADCAST_IDS = 1_000_000


def signals_of(todo: DataFrame, signals: DataFrame) -> DataFrame:
    """The signals of the wanted rows.

    Signals are wide, so they should not be shuffled to find a few of them: a checked, small number of
    ids is broadcast. Beyond that both sides meet on the row id, without a shuffle if both are bucketed
    by it.
    """
    ids = todo.select("row_id")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return signals.join(F.broadcast(ids) if few else ids, "row_id", "left_semi")


def run_job(
    manifest: DataFrame, signals: DataFrame, store_path: str, status_path: str, load: Callable[[], Extractor],
    dataset: str, model_hash: str, layer: int = 0, only_shards: list[int] | None = None, layered: bool = False,
    minimum_seconds: float | None = None, rate: int | None = None,
) -> int:
    """Extract what is missing, append it to the store and log each shard. Returns the rows in the store.

    Rows that are in the store are never made again, and a run leaves shards alone that another run has
    claimed and not ended, so any number of runs, also at the same time, gives the same store.
    ``only_shards`` confines a run to some shards. With ``layered`` the extractor gives a matrix per
    sample, and each of its rows is stored under its layer. Samples shorter than ``minimum_seconds`` at
    ``rate`` are not extracted.

    Every run logs under an id of its own: in progress before the work; afterwards a shard is done only
    if all its samples are in the store, and failed, with the number that is not, otherwise. An error in the
    work marks the shards this run has started, with the whole error, and is raised again.
    """
    spark = manifest.sparkSession
    run = uuid.uuid4().hex
    wanted = manifest if only_shards is None else manifest.filter(F.col("dataset_shard").isin(only_shards))
    wanted = wanted.select("row_id", "dataset_shard")

    def stored() -> DataFrame | None:
        if not sinks.exists(spark, store_path):
            return None
        rows = spark.read.parquet(store_path).filter(
            (F.col("dataset") == dataset) & (F.col("model_hash") == model_hash)
        )
        # The layers of a sample are appended together, so one of them stands for all.
        return rows if layered else rows.filter(F.col("layer") == layer)

    def log(shards_: DataFrame) -> None:
        """Rows (dataset_shard, status, message) into the status log."""
        sinks.append_status(shards_.select(
            F.lit(dataset).alias("dataset"), F.lit(model_hash).alias("model_hash"),
            F.col("dataset_shard").alias("shard"), "status", "message", F.current_timestamp().alias("ts"),
            F.lit(run).alias("run"),
        ), status_path)

    def work(held: claims.Claim, wanted: DataFrame) -> int:
        before = stored()
        # Pinned, because the rows are no longer missing once their vectors are written.
        todo = pin(missing(wanted, before) if before is not None else wanted)
        started = todo.select("dataset_shard").distinct()
        tell = lambda status, message="": started.withColumns({"status": F.lit(status), "message": F.lit(message)})
        log(tell(shards.IN_PROGRESS))
        try:
            chosen = signals_of(todo, signals)
            if minimum_seconds is not None:
                chosen = chosen.filter(F.size("samples") >= minimum_seconds * rate)
            made = extract(chosen, load, layered=layered)
            keys = [F.lit(dataset).alias("dataset"), F.lit(model_hash).alias("model_hash")]
            if layered:
                rows = pooling.layer_rows(made, "embedding", "row_id").select(*keys, "layer", "row_id", "embedding")
            else:
                rows = made.select(*keys, F.lit(layer).alias("layer"), "row_id", "embedding")
            held.check()
            sinks.append_embeddings(rows, store_path)
        except Exception as problem:
            log(tell(shards.FAILED, str(problem)))
            raise
        after = stored()
        if after is None:
            after = spark.createDataFrame([], "row_id long")
        here = after.select("row_id").distinct().withColumn("there", F.lit(1))
        counted = wanted.join(here, "row_id", "left").groupBy("dataset_shard").agg(
            F.count(F.lit(1)).alias("n"), F.count("there").alias("n_there")
        )
        lacking = F.col("n") - F.col("n_there")
        log(counted.select(
            "dataset_shard", F.when(lacking > 0, shards.FAILED).otherwise(shards.DONE).alias("status"),
            F.when(lacking > 0, F.concat(lacking.cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" samples have no vector")))
            .otherwise("").alias("message"),
        ))
        return after.count()

    place = f"{store_path.rstrip('/')}.claims/{dataset}/{model_hash}/{'layers' if layered else layer}"
    held, free = claims.claim(wanted.select(F.col("dataset_shard").alias("shard")).distinct(), place, run)
    try:
        return work(held, wanted.join(free, F.col("dataset_shard") == F.col("shard"), "left_semi"))
    finally:
        held.close()


def check_store(manifest: DataFrame, store: DataFrame, max_samples: int = fv.SAMPLES_PER_SHARD) -> None:
    """Fail unless the store has one vector of one length for every sample, and the manifest all its shards."""
    n = guards.check_row_counts(manifest, store)
    shards.check_shard_count(manifest.select("dataset_shard").distinct().count(), n, max_samples)
    if not guards.dimension_range(store, "embedding").first()["is_uniform"]:
        raise RuntimeError("vectors of the store differ in length")
    if not guards.uniqueness(store, "row_id").first()["is_unique"]:
        raise RuntimeError("a sample is stored more than once")


def failed_shards(spark, status_path: str, dataset: str, model_hash: str) -> list[int]:
    """Shards whose latest log row says failed, or has been in progress for too long."""
    rows = spark.read.parquet(status_path).filter((F.col("dataset") == dataset) & (F.col("model_hash") == model_hash))
    latest = shards.latest_status(rows, rows.select("shard").distinct(), F.current_timestamp(), ["shard"])
    # A shard list is as short as the job's files are few.
    return sorted(r["shard"] for r in shards.failed_shards(latest).collect())


def run_planned(plan: DataFrame, status_path: str, run: Callable[[str, str, list[int] | None], None]) -> int:
    """Carry a plan out: ``run(dataset, model_hash, shards)`` for every run to be extracted, with None for all
    its shards, and for every run to be repaired, with its failed ones. Returns how many were run."""
    spark, n = plan.sparkSession, 0
    for row in plan.filter(F.col("action").isin("extract", "repair")).orderBy("dataset", "model_hash").toLocalIterator():
        repair = row["action"] == "repair"
        run(row["dataset"], row["model_hash"], failed_shards(spark, status_path, row["dataset"], row["model_hash"]) if repair else None)
        n += 1
    return n

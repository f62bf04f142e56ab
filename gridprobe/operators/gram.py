"""Sums of products of vectors and a label, from which every ridge fit and its scores follow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sums of a split are the square of the width; wider vectors are trained by mini-batches instead.
WIDEST = 4_096
# Sums of tasks meet in so many groups before they meet in one.
FAN_IN = 16


def gram(rows: DataFrame, label: str = "y", vector: str = "embedding", by: str = "split") -> DataFrame:
    """(by, n, width, origin, products): one row per group, mergeable by adding ``n`` and ``products``.

    ``products`` is the matrix of the sums of z z' over the group's rows, row by row, for z = (1, vector, label)
    measured from ``origin``, a row of the table, so that a common offset costs no digits. A task adds up
    whole blocks of rows, so one matrix per task and group is shuffled. Rows with a NULL label or vector, or a
    NULL in it, take no part; vectors must have one length; an empty table gives an empty result.
    """
    usable = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    cells = usable.select(
        F.col(by).cast("string").alias("by"), F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(F.col(label).cast("double"))).alias("z")
    )
    # Any row will do; the least hash makes it the same one every time.
    first = cells.agg(F.min_by("z", F.xxhash64("z")).alias("z")).first()["z"]
    shape = "by string, n long, products binary"
    if first is None:
        return usable.sparkSession.createDataFrame([], f"{by} string, n long, width int, origin array<double>, products array<double>")
    width = len(first) - 1
    if width > WIDEST:
        raise ValueError(f"vectors of {width} components; sums of products are kept up to {WIDEST}")
    origin = np.array(first)

    def record(sums: dict) -> Iterator[pa.RecordBatch]:
        for key, (n, total) in sums.items():
            yield pa.record_batch({"by": pa.array([key], pa.string()), "n": pa.array([n], pa.int64()), "products": pa.array([total.tobytes()], pa.binary())})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("z")
            if len(z.flatten()) != batch.num_rows * (width + 1) or not (np.diff(z.offsets.to_numpy()) == width + 1).all():
                raise ValueError(f"vectors are not all {width} long")
            z = z.flatten().to_numpy().reshape(batch.num_rows, width + 1) - origin
            z = np.concatenate((np.ones((len(z), 1)), z), axis=1)
            keys = np.array(batch.column("by").to_pylist(), object)
            for key in dict.fromkeys(keys.tolist()):
                part = z[keys == key]
                n, total = sums.get(key, (0, 0.0))
                sums[key] = n + len(part), total + part.T @ part
        yield from record(sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for key, n, blob in zip(*(batch.column(c).to_pylist() for c in ("by", "n", "products"))):
                held, total = sums.get(key, (0, 0.0))
                sums[key] = held + n, total + np.frombuffer(blob)
        yield from record(sums)

    parts = cells.mapInArrow(fold, shape).withColumn("bucket", F.spark_partition_id() % FAN_IN)
    merged = parts.repartition("by", "bucket").drop("bucket").mapInArrow(merge, shape).repartition("by").mapInArrow(merge, shape)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.frombuffer(b) for b in batch.column("products").to_pylist()]
            yield pa.record_batch({
                by: batch.column("by"), "n": batch.column("n"), "width": pa.array([width] * batch.num_rows, pa.int32()),
                "origin": pa.array([origin] * batch.num_rows, pa.list_(pa.float64())), "products": pa.array(blobs, pa.list_(pa.float64())),
            })

    return merged.mapInArrow(listed, f"{by} string, n long, width int, origin array<double>, products array<double>")


def _moments(row) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means from the origin and covariance (by n) of (vector, label)."""
    size = row["width"] + 2
    products = np.array(row["products"]).reshape(size, size) / row["n"]
    means = products[0, 1:]
    return row["n"], means, products[1:, 1:] - np.outer(means, means)


def ridge(sums: DataFrame, decays: list[float], standardised: tuple[bool, ...] = (True, False), fit_on: str = "train",
          by: str = "split") -> list[dict]:
    """Every ridge fit by L2 and scaling, with its loss and R2 on every group, without reading a row again.

    A fit minimises half the mean squared error plus half the decay times the squared weights over the group
    ``fit_on``; the intercept is free. With scaling, components are divided by their deviations there, and the
    weights that are returned belong to the original components. Records have decay, standardised, weights,
    intercept, and per group n, loss and r2 (None where the label is constant). The sums are as large as
    the square of the width, whatever the number of rows.
    """
    groups = {r[by]: r for r in sums.collect()}
    if fit_on not in groups:
        raise ValueError(f"there are no rows of {fit_on}")
    origin = np.array(groups[fit_on]["origin"])
    moments = {name: _moments(row) for name, row in groups.items()}
    _, means, covariance = moments[fit_on]
    deviations = np.sqrt(np.maximum(np.diag(covariance)[:-1], 0))
    out = []
    for scaled in standardised:
        scale = np.where(deviations > 0, deviations, 1.0) if scaled else np.ones_like(deviations)
        inner = covariance[:-1, :-1] / np.outer(scale, scale)
        target = covariance[:-1, -1] / scale
        for decay in decays:
            system = inner + decay * np.eye(len(scale))
            # Without decay, components may depend on each other; the shortest solution is taken then.
            solved = np.linalg.solve(system, target) if decay else np.linalg.lstsq(system, target, rcond=1e-12)[0]
            weights = solved / scale
            lift = means[-1] - weights @ means[:-1]
            scores = {}
            for name, (n, centre, spread) in moments.items():
                toward = np.append(-weights, 1.0)
                bias = toward @ centre - lift
                loss = float(toward @ spread @ toward + bias**2)
                scores[name] = {"n": n, "loss": loss, "r2": float(1 - loss / spread[-1, -1]) if spread[-1, -1] > 0 else None}
            out.append({
                "decay": decay, "standardised": scaled, "weights": weights,
                "intercept": float(lift + origin[-1] - weights @ origin[:-1]), "scores": scores,
            })
    return out


def ridge_scores(sums: DataFrame, decays: list[float], standardised: tuple[bool, ...] = (True, False), fit_on: str = "train",
                 by: str = "split") -> DataFrame:
    """(decay, standardised, by, n, loss, r2) of every fit of ``ridge``."""
    flat = [
        (float(fit["decay"]), fit["standardised"], name, s["n"], s["loss"], s["r2"])
        for fit in ridge(sums, decays, standardised, fit_on, by) for name, s in sorted(fit["scores"].items())
    ]
    return sums.sparkSession.createDataFrame(flat, f"decay double, standardised boolean, {by} string, n long, loss double, r2 double")

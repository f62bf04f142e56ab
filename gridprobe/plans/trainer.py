"""First-order training of probes, many configurations in one scan of the same features.

Training rows are dealt to shards of a fixed size, which are written once. In a pass, a task takes seeded
mini-batches from its shard and runs Adam with dropout and L2 from the common weights; the weights and
moments that come back are averaged by rows. With one shard a pass is the plain loop. All configurations of a
lot are trained on a shard while it is read, so a sweep costs the scans of its longest fit.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.operators import scaling
from gridprobe.session import scratch_path
from gridprobe.sources.configs import ProbeConfig

# A shard holds at most so many rows and bytes of features.
SHARD_ROWS = 16_384
SHARD_BYTES = 16 << 20
# Weights and moments of the configurations that are trained in one scan; more are trained lot by lot.
STATE_BYTES = 64 << 20
# Partial sums of a configuration meet in so many tasks before they meet in one.
FAN_IN = 16
# The optimiser's decay rates and the term that keeps its steps finite.
FIRST_DECAY, SECOND_DECAY, EPSILON = 0.9, 0.999, 1e-8


@dataclass
class Network:
    """Layers (weights [in, out], bias), with a rectifier between them."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def initial(width: int, hidden: Sequence[int], outputs: int, seed: int) -> Network:
        """Uniform within 1 / sqrt(inputs) of zero, by the seed alone."""
        rng = np.random.default_rng([seed, 0])
        layers, inputs = [], width
        for size in (*hidden, outputs):
            bound = 1 / math.sqrt(max(inputs, 1))
            layers.append((rng.uniform(-bound, bound, (inputs, size)), rng.uniform(-bound, bound, size)))
            inputs = size
        return Network([(w.astype(np.float32), b.astype(np.float32)) for w, b in layers])

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return [w.shape for w, _ in self.layers]

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for layer in self.layers for part in layer])

    @staticmethod
    def of(flat: np.ndarray, shapes: list[tuple[int, int]]) -> Network:
        """Views into ``flat``, so that a step on it moves the layers."""
        layers, at = [], 0
        for rows, columns in shapes:
            weights = flat[at : at + rows * columns].reshape(rows, columns)
            at += rows * columns
            layers.append((weights, flat[at : at + columns]))
            at += columns
        return Network(layers)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        for i, (weights, bias) in enumerate(self.layers):
            x = (np.maximum(x, 0) if i else x) @ weights + bias
        return x

    def to_json(self) -> dict:
        text = lambda a: base64.b64encode(np.ascontiguousarray(a, "<f4").tobytes()).decode()
        return {"layers": [[list(w.shape), text(w), text(b)] for w, b in self.layers]}

    @staticmethod
    def from_json(found: dict) -> Network:
        array = lambda t: np.frombuffer(base64.b64decode(t), "<f4")
        return Network([(array(w).reshape(shape), array(b)) for shape, w, b in found["layers"]])


@dataclass
class Settings:
    """What a task needs to know of a configuration."""

    seed: int
    batch: int
    rate: float
    dropout: float
    decay: float
    standardised: bool
    shapes: list[tuple[int, int]]
    regression: bool

    @staticmethod
    def of(config: ProbeConfig, width: int, output_type: str) -> Settings:
        sizes = [width, *config["hidden_layer_sizes"], config["num_outputs"]]
        return Settings(
            config["seed"], config["batch_size"], config["learning_rate"], config["dropout_p"] or 0.0,
            config["l2_weight_decay"] or 0.0, bool(config["data_standardization"]), list(zip(sizes, sizes[1:])),
            output_type == "regression",
        )


def _loss_and_error(out: np.ndarray, y: np.ndarray, regression: bool) -> tuple[np.ndarray, np.ndarray]:
    """Loss per row, and its derivative by the outputs."""
    if regression:
        gap = out[:, 0] - y
        return gap**2, (2 * gap)[:, None]
    at = np.arange(len(y)), y.astype(np.int64)
    shifted = out - out.max(axis=1, keepdims=True)
    total = np.exp(shifted).sum(axis=1, keepdims=True)
    error = np.exp(shifted) / total
    error[at] -= 1
    return np.log(total[:, 0]) - shifted[at], error


def _gradient(net: Network, x: np.ndarray, y: np.ndarray, given: Settings, rng: np.random.Generator) -> np.ndarray:
    """The mean loss's derivative by the flat weights, with dropout before every layer."""

    def dropped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        if not given.dropout:
            return values, None
        mask = (rng.random(values.shape, np.float32) >= given.dropout) / np.float32(max(1 - given.dropout, 1e-9))
        return values * mask, mask

    held, masks, values = [], [], x
    for i, (weights, bias) in enumerate(net.layers):
        values, mask = dropped(np.maximum(values, 0) if i else values)
        held.append(values)
        masks.append(mask)
        values = values @ weights + bias
    _, error = _loss_and_error(values, y, given.regression)
    error = (error / len(y)).astype(np.float32)
    parts: list[np.ndarray] = []
    for i in range(len(net.layers) - 1, -1, -1):
        parts = [(held[i].T @ error).ravel(), error.sum(axis=0), *parts]
        if i:
            error = error @ net.layers[i][0].T
            if masks[i] is not None:
                error = error * masks[i]
            error = error * (held[i] > 0)
    return np.concatenate(parts)


def run_pass(state: np.ndarray, steps: int, x: np.ndarray, y: np.ndarray, given: Settings, number: int, shard: int) -> np.ndarray:
    """The state (weights, first and second moments) after one pass over a shard in seeded mini-batches."""
    rng = np.random.default_rng([given.seed, 1, number, shard])
    theta, first, second = state.reshape(3, -1).astype(np.float32)
    net = Network.of(theta, given.shapes)
    order = rng.permutation(len(x))
    for at in range(0, len(x), given.batch):
        rows = order[at : at + given.batch]
        gradient = _gradient(net, x[rows], y[rows], given, rng) + np.float32(given.decay) * theta
        steps += 1
        first += (1 - FIRST_DECAY) * (gradient - first)
        second += (1 - SECOND_DECAY) * (gradient**2 - second)
        scale = np.sqrt(second / (1 - SECOND_DECAY**steps)) + EPSILON
        theta -= given.rate / (1 - FIRST_DECAY**steps) * first / scale
    return np.concatenate((theta, first, second))


def _scores(net: Network, x: np.ndarray, y: np.ndarray, regression: bool) -> np.ndarray:
    """Sums that metrics follow from: rows, loss, hits, label and squared label about one half."""
    out = net.outputs(x)
    loss, _ = _loss_and_error(out.astype(np.float64), y, regression)
    hits = 0 if regression else float((out.argmax(axis=1) == y).sum())
    about = y - 0.5
    return np.array([len(y), loss.sum(), hits, about.sum(), (about**2).sum()])


def _metrics(sums: np.ndarray, regression: bool) -> dict[str, float]:
    """The same names as ``operators/metrics.py`` gives."""
    n, loss, hits, total, squares = sums.tolist()
    if regression:
        spread = squares - total**2 / n
        main = 1 - loss / spread if spread > 0 else None
        names = {"r2": main}
    else:
        main = hits / n
        names = {"accuracy": main, "f1": main}
    return {"n": n, "loss": loss / n, **names, "primary_eval_metric": main, "primary": main}


# --- shards -----------------------------------------------------------------------------------


def sharded(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(split, shard, features, labels): rows (row_id, y, embedding, split) dealt by a hash of the row id, one record
    per shard, written once; with the rows of a full shard. Inside a shard rows are in the order of their id."""
    spark = rows.sparkSession
    size = max(1, min(SHARD_ROWS, SHARD_BYTES // max(4 * width, 1)))
    sizes = rows.groupBy("split").agg(F.ceil(F.count(F.lit(1)) / size).alias("shards"))
    dealt = rows.join(F.broadcast(sizes), "split").select(
        "split", F.pmod(F.xxhash64("row_id"), F.col("shards")).cast("int").alias("shard"), "row_id",
        F.col("y").cast("double").alias("y"), F.col("embedding").cast("array<float>").alias("embedding"),
    )

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        x = table.column("embedding").combine_chunks().flatten().to_numpy()
        if len(x) != len(table) * width:
            raise ValueError(f"vectors of shard {key[1].as_py()} are not all {width} long")
        return pa.table({
            "split": pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "features": pa.array([x.astype("<f4").tobytes()], pa.binary()),
            "labels": pa.array([table.column("y").to_numpy().astype("<f8").tobytes()], pa.binary()),
        })

    path = scratch_path(spark, "shards")
    packed = dealt.groupBy("split", "shard").applyInArrow(pack, "split string, shard int, features binary, labels binary")
    packed.write.parquet(path)
    return spark.read.schema(packed.schema).parquet(path), size


def _summed(parts: DataFrame) -> dict[tuple[int, str], np.ndarray]:
    """Sums of the blobs per (config, kind), in two rounds of tasks that hold one sum per key at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            for config, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("config", "kind", "blob"))):
                part = np.frombuffer(blob, np.float64)
                held = sums.get((config, kind))
                if held is None:
                    sums[config, kind] = part.copy()
                else:
                    held += part
        for (config, kind), total in sums.items():
            yield _blob(config, kind, total)

    shape = parts.schema
    some = parts.withColumn("bucket", F.spark_partition_id() % FAN_IN).repartition("config", "kind", "bucket").drop("bucket")
    found = some.mapInArrow(add, shape).repartition("config", "kind").mapInArrow(add, shape)
    return {(r["config"], r["kind"]): np.frombuffer(bytes(r["blob"]), np.float64) for r in found.collect()}


def _blob(config: int, kind: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({
        "config": pa.array([config], pa.int32()), "kind": pa.array([kind]),
        "blob": pa.array([values.astype(np.float64).tobytes()], pa.binary()),
    })


def _scan(shards: DataFrame, settings: dict[int, Settings], states: dict[int, tuple[np.ndarray, int]], scaler,
          number: int, training: set[int], scoring: set[int], splits: Sequence[str]) -> dict:
    """One scan: every configuration in ``training`` makes a pass, and the given weights of those in ``scoring`` are
    evaluated on ``splits``. A state comes back as its sum over shards, weighted by rows, behind their number."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast((settings, states, scaler))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settings, states, (means, deviations) = shared.value
        sums: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                y = np.frombuffer(row["labels"], "<f8")
                raw = np.frombuffer(row["features"], "<f4").reshape(len(y), -1)
                plain = {False: raw}
                if any(settings[k].standardised for k in training | scoring):
                    plain[True] = ((raw - means) / deviations).astype(np.float32)
                for k in sorted(training | scoring):
                    given, (state, steps) = settings[k], states[k]
                    x = plain[given.standardised]
                    found = []
                    if k in training and row["split"] == "train":
                        moved = run_pass(state, steps, x, y, given, number, row["shard"])
                        found.append(("state", np.concatenate(([len(y)], len(y) * moved.astype(np.float64)))))
                    if k in scoring and row["split"] in splits:
                        net = Network.of(state.reshape(3, -1)[0], given.shapes)
                        found.append((row["split"], _scores(net, x, y, given.regression)))
                    for kind, part in found:
                        sums[k, kind] = sums[k, kind] + part if (k, kind) in sums else part
        for (k, kind), total in sums.items():
            yield _blob(k, kind, total)

    wanted = ["train"] * bool(training) + [s for s in splits if scoring]
    sums = _summed(shards.filter(F.col("split").isin(wanted)).mapInArrow(work, "config int, kind string, blob binary"))
    shared.unpersist()
    return sums


# --- training ---------------------------------------------------------------------------------


@dataclass
class NetworkProbe:
    """A trained probe with the scaler it was trained behind, its log of evaluations and its metrics per split."""

    config: ProbeConfig
    model: Network
    means: list[float] | None
    deviations: list[float] | None
    output_type: str
    log: list[dict] = field(default_factory=list)
    metrics: dict[str, dict] = field(default_factory=dict)

    def score(self, df: DataFrame, embedding: str = "embedding") -> DataFrame:
        """Add ``prediction``, and ``logits`` for a classifier."""
        classifier = self.output_type != "regression"
        shared = df.sparkSession.sparkContext.broadcast((self.model, self.means, self.deviations))
        added = {"prediction": F.lit(0.0)} | ({"logits": F.array(F.lit(0.0))} if classifier else {})
        names = list(added)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, means, deviations = shared.value
            for batch in batches:
                x = np.array(batch.column(embedding).to_pylist(), np.float32).reshape(batch.num_rows, -1)
                if means is not None:
                    x = ((x - np.array(means)) / np.array(deviations)).astype(np.float32)
                out = net.outputs(x).astype(np.float64) if batch.num_rows else np.empty((0, 1))
                best = out.argmax(axis=1).astype(np.float64) if classifier else out[:, 0]
                columns = [pa.array(best)] + ([pa.array(list(out), pa.list_(pa.float64()))] if classifier else [])
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

        return df.mapInArrow(work, df.withColumns(added).schema)


def _lots(settings: list[Settings]) -> Iterator[list[int]]:
    """Configurations whose states fit together; one alone may be larger."""
    lot, held = [], 0
    for k, given in enumerate(settings):
        size = 3 * 8 * sum(rows * columns + columns for rows, columns in given.shapes)
        if lot and held + size > STATE_BYTES:
            yield lot
            lot, held = [], 0
        lot.append(k)
        held += size
    if lot:
        yield lot


def train(rows: DataFrame, configs: Sequence[ProbeConfig], output_type: str) -> list[NetworkProbe]:
    """Train every configuration on the training rows of an assembled table (row_id, y, embedding, split).

    A pass is an epoch. ``max_num_epochs`` bounds the passes. With early stopping, the validation rows are
    evaluated before the first pass and then between passes whenever ``early_stopping_eval_frequency`` steps of a
    shard have gone by since; after ``early_stopping_boredom`` evaluations in turn that bring nothing better the best
    weights stand, while training that its epochs end keeps the last ones. A NaN score is an error. Batch size, learning
    rate, dropout (before every layer), L2 (on every weight and bias), hidden layers and standardisation all act.
    The scaler is fitted once, on all training rows. A configuration's fit depends on the rows and itself
    alone, not on those it is trained with. Splits without rows have no metrics.
    """
    if output_type not in ("multiclass", "regression"):
        raise ValueError(f"Unsupported output type: {output_type}")
    training = rows.filter("split = 'train'")
    if training.isEmpty():
        raise ValueError("there are no training rows")
    stats = scaling.dimension_stats(training, "embedding").first()
    means, deviations = np.array(stats["means"]), np.array(stats["deviations"])
    deviations[deviations == 0] = 1.0
    width = len(means)
    settings = [Settings.of(c, width, output_type) for c in configs]
    shards, full = sharded(rows, width)
    n_train = stats["n"]
    out: list[NetworkProbe | None] = [None] * len(configs)
    for lot in _lots(settings):
        for k, probe in _trained_lot(shards, min(full, n_train), configs, settings, lot, (means, deviations), output_type):
            out[k] = probe
    return out


def _trained_lot(shards, shard_rows, configs, settings, lot, scaler, output_type):
    means, deviations = scaler
    here = {k: settings[k] for k in lot}
    states = {}
    for k in lot:
        flat = Network.initial(len(means), configs[k]["hidden_layer_sizes"], configs[k]["num_outputs"], configs[k]["seed"]).flat()
        states[k] = (np.concatenate((flat, np.zeros(2 * len(flat), np.float32))), 0)
    per_pass = {k: -(-shard_rows // settings[k].batch) for k in lot}
    logs: dict[int, list[dict]] = {k: [] for k in lot}
    best: dict[int, tuple[float, np.ndarray]] = {}
    boredom, evaluated = dict.fromkeys(lot, 0), dict.fromkeys(lot, -1)
    waiting, number = set(lot), 0
    while waiting:
        # The evaluation of a pass's first weights shares its scan.
        due = {
            k for k in waiting if configs[k]["early_stopping"]
            and states[k][1] // configs[k]["early_stopping_eval_frequency"] > evaluated[k]
        }
        training = {k for k in waiting if configs[k]["max_num_epochs"] is None or number < configs[k]["max_num_epochs"]}
        sums = _scan(shards, here, {k: states[k] for k in waiting}, (means, deviations), number, training, due & training, ["valid"])
        for k in sorted(due & training):
            config = configs[k]
            evaluated[k] = states[k][1] // config["early_stopping_eval_frequency"]
            if (k, "valid") not in sums:
                raise ValueError("early stopping needs validation rows")
            found = _metrics(sums[k, "valid"], settings[k].regression)
            name = config["early_stopping_metric"]
            value = found[name.removeprefix("-")]
            score = float("nan") if value is None else -value if name.startswith("-") else value
            if math.isnan(score):
                raise ValueError(f"NaN score: {name} in step {states[k][1]}")
            if k not in best or score > best[k][0]:
                best[k], boredom[k] = (score, states[k][0]), 0
            else:
                boredom[k] += 1
            logs[k].append({"step": states[k][1], "score": score, "best_score": best[k][0], "boredom": boredom[k]})
            if boredom[k] >= config["early_stopping_boredom"]:
                states[k] = (best[k][1], states[k][1])
                training.discard(k)
        for k in training:
            total = sums[k, "state"]
            states[k] = ((total[1:] / total[0]).astype(np.float32), states[k][1] + per_pass[k])
        waiting, number = training, number + 1
    sums = _scan(shards, here, states, (means, deviations), number, set(), set(lot), ["train", "valid", "test"])
    for k in lot:
        given = settings[k]
        probe = NetworkProbe(
            configs[k], Network.of(states[k][0].reshape(3, -1)[0], given.shapes),
            means.tolist() if given.standardised else None, deviations.tolist() if given.standardised else None, output_type, logs[k],
            {split: _metrics(sums[k, split], given.regression) for split in ("train", "valid", "test") if (k, split) in sums},
        )
        yield k, probe


def metric_rows(spark: SparkSession, probes: Sequence[NetworkProbe]) -> DataFrame:
    """(uid, split, metric, value) of trained probes: a handful per configuration."""
    flat = [
        (p.config.uid(), split, name, None if value is None else float(value))
        for p in probes for split, found in p.metrics.items() for name, value in found.items()
    ]
    return spark.createDataFrame(flat, "uid string, split string, metric string, value double")


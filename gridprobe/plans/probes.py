"""Probes: labels and embeddings in, fitted models and metrics out.

Fits here use Spark ML, so each is a distributed job over a persisted feature table. The optimiser is
L-BFGS or a full-batch solver: learning rate, batch size and dropout have no counterpart there and
only identify a configuration. A hidden layer uses the library's own activation. ``plans/trainer.py`` trains
with mini-batches, where all of them act; its probes are evaluated and saved by the functions here too.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import count
from pathlib import PurePosixPath

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.functions import fixed_values as fv
from gridprobe.functions import vectors
from gridprobe.functions.literals import literal
from gridprobe.functions.signal import widen
from gridprobe.operators import labels, metrics, scaling, splits
from gridprobe.plans.trainer import Network, NetworkProbe
from gridprobe.sources import sinks
from gridprobe.sources.configs import ProbeConfig

# Passes over the training rows where a configuration names none.
ITERATIONS = 100
# Components of vectors that one task of a fit goes through in a pass: 32 MB as doubles.
TASK_CELLS = 1 << 22
_LOADERS = {
    "LogisticRegressionModel": LogisticRegressionModel,
    "MultilayerPerceptronClassificationModel": MultilayerPerceptronClassificationModel,
    "LinearRegressionModel": LinearRegressionModel,
}


def assemble(
    table: DataFrame, embeddings: DataFrame, label: str, output_type: str, seed: int = 0,
    extrapolate: bool | None = None, row_id: str = "row_id", embedding: str = "embedding",
) -> DataFrame:
    """(row_id, y, embedding, split): encoded labels with their split, joined to their vectors.

    The split is made on the narrow label table, and only then are vectors joined. Both sides have a row per
    id and grow together, so neither is broadcast, which would send it through the driver. Regression on a
    label range is split by extrapolation, everything else by shuffle.
    """
    narrow = table.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"))
    if output_type == "regression":
        scaled = scaling.min_max(narrow, "label", "y")
        by_range = extrapolate is None or extrapolate
        divided = splits.extrapolation_split(scaled, "label", seed=seed) if by_range else splits.shuffle_split(
            scaled, seed=seed
        )
    elif output_type == "multiclass":
        divided = splits.shuffle_split(labels.encode(narrow, "label", "y"), seed=seed)
    else:
        raise ValueError(f"Unsupported output type: {output_type}")
    return divided.join(
        embeddings.select(F.col(row_id).alias("row_id"), F.col(embedding).alias("embedding")).hint("merge"), "row_id"
    ).select("row_id", F.col("y").cast("double").alias("y"), "embedding", "split")


@dataclass
class Probe:
    """A fitted probe with the scaler it was trained behind."""

    config: ProbeConfig
    model: Model
    means: list[float] | None
    deviations: list[float] | None

    @property
    def output_type(self) -> str:
        return "regression" if isinstance(self.model, LinearRegressionModel) else "multiclass"

    def features(self, df: DataFrame, embedding: str = "embedding") -> DataFrame:
        wide = widen(F.col(embedding))
        if self.means is not None:
            wide = vectors.standardised(F.col(embedding), literal(self.means), literal(self.deviations))
        return df.withColumn("features", array_to_vector(wide))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and ``logits`` for a classifier."""
        scored = self.model.transform(self.features(df))
        if self.output_type == "regression":
            return scored.drop("features")
        logits = vector_to_array(F.col("rawPrediction"))
        return scored.withColumn("logits", logits).drop("features", "rawPrediction", "probability")


@contextmanager
def packed(rows: DataFrame, embedding: str = "embedding") -> Iterator[DataFrame]:
    """The rows persisted, in as many tasks as there are cores, and more only where vectors fill them.

    A solver passes over its rows a hundred times, and every task of a pass reports to the driver. The shuffle
    behind the rows may have cut them into hundreds of small partitions; what is kept is read by fewer
    tasks, without being moved.
    """
    shared = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cells = shared.agg(F.coalesce(F.sum(F.size(embedding)), F.lit(0))).first()[0]
        yield shared.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-cells // TASK_CELLS)))
    finally:
        shared.unpersist()


def fit(train: DataFrame, config: ProbeConfig, output_type: str, iterations: int | None = None) -> Probe:
    """Fit on the training rows (y, embedding); the scaler is fitted once, on the same rows.

    ``max_num_epochs`` of the configuration bounds the solver's passes unless ``iterations`` does; the solver
    ends earlier when it has converged.
    """
    with packed(train.select("y", "embedding")) as kept:
        return _fit(kept, config, output_type, iterations)


def _fit(train: DataFrame, config: ProbeConfig, output_type: str, iterations: int | None = None) -> Probe:
    iterations = iterations or config["max_num_epochs"] or ITERATIONS
    means = deviations = None
    if config["data_standardization"]:
        # One row of two vectors as wide as one embedding.
        stats = scaling.dimension_stats(train, "embedding").first()
        means, deviations = list(stats["means"]), list(stats["deviations"])
    probe = Probe(config, None, means, deviations)
    rows = probe.features(train).select("y", "features")
    hidden = list(config["hidden_layer_sizes"])
    decay = config["l2_weight_decay"] or 0.0
    if output_type == "regression":
        learner = LinearRegression(
            labelCol="y", maxIter=iterations, regParam=decay, standardization=False, solver="l-bfgs"
        )
    elif hidden:
        width = len(means) if means else train.select(F.size("embedding")).first()[0]
        learner = MultilayerPerceptronClassifier(
            labelCol="y", layers=[width, *hidden, config["num_outputs"]], maxIter=iterations, seed=config["seed"]
        )
    else:
        learner = LogisticRegression(
            labelCol="y", family="multinomial", maxIter=iterations, regParam=decay, standardization=False
        )
    probe.model = learner.fit(rows)
    return probe


def fit_with_early_stopping(
    train: DataFrame, valid: DataFrame, config: ProbeConfig, max_rounds: int | None = None
) -> tuple[Probe, list[dict]]:
    """Train a classifier in rounds and keep the round with the best validation metric.

    A round continues from the weights of the round before for ``early_stopping_eval_frequency``
    iterations. Training ends when ``early_stopping_boredom`` rounds in turn brought nothing better, or
    after ``max_rounds``, by default as many as ``max_num_epochs`` has room for. A NaN metric is an error. Also returns the log, one record per round.
    """
    sign, metric = 1, config["early_stopping_metric"]
    if metric.startswith("-"):
        sign, metric = -1, metric[1:]
    with packed(train.select("y", "embedding")) as kept, packed(valid.select("y", "embedding")) as held:
        means = deviations = None
        if config["data_standardization"]:
            stats = scaling.dimension_stats(kept, "embedding").first()
            means, deviations = list(stats["means"]), list(stats["deviations"])
        featured = Probe(config, None, means, deviations).features(kept).select("y", "features")
        width = len(means) if means else held.select(F.size("embedding")).first()[0]
        learner = MultilayerPerceptronClassifier(
            labelCol="y", layers=[width, *config["hidden_layer_sizes"], config["num_outputs"]], seed=config["seed"],
            maxIter=config["early_stopping_eval_frequency"],
        )
        log, best, boredom = [], None, 0
        every = config["early_stopping_eval_frequency"]
        if max_rounds is None and config["max_num_epochs"]:
            max_rounds = -(-config["max_num_epochs"] // every)
        for step in count():
            if boredom >= config["early_stopping_boredom"] or step == max_rounds:
                break
            model = learner.fit(featured)
            learner.setInitialWeights(model.weights)
            score = sign * evaluate(Probe(config, model, means, deviations), held).first()[metric]
            if math.isnan(score):
                raise ValueError(f"{metric} is NaN in round {step}")
            boredom = 0 if best is None or score > best[0] else boredom + 1
            if boredom == 0:
                best = (score, model)
            log.append({"step": step, "score": score, "best_score": best[0], "boredom": boredom})
    return Probe(config, best[1], means, deviations), log


def evaluate(probe: Probe | NetworkProbe, rows: DataFrame, *by: str) -> DataFrame:
    """Metrics of the probe on assembled rows, per group."""
    scored = probe.score(rows)
    if probe.output_type == "regression":
        return metrics.reject_nan(metrics.regression(scored, "y", "prediction", *by), "loss")
    coded = scored.withColumn("y", F.col("y").cast("int"))
    return metrics.reject_nan(metrics.classification(coded, "y", "logits", *by), "loss")


def confusion(probe: Probe | NetworkProbe, rows: DataFrame) -> DataFrame:
    scored = probe.score(rows).select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
    return metrics.confusion_matrix(scored, "y", "p")


def sweep(
    rows: DataFrame, configs: Iterable[ProbeConfig], output_type: str, parallelism: int = 4,
    iterations: int | None = None,
) -> DataFrame:
    """Fit and evaluate many configurations of one (concept, model, layer) over one feature table.

    The table is packed once and shared. Each fit is a Spark job over all executors; a few run at
    a time so that small fits do not leave the cluster idle. Metrics are a handful of rows per
    configuration: (uid, split, metric, value).
    """
    spark = rows.sparkSession
    with packed(rows) as shared:
        train = shared.filter(F.col("split") == "train")

        def one(config: ProbeConfig) -> list[tuple]:
            probe = _fit(train, config, output_type, iterations)
            wide = evaluate(probe, shared, "split")
            long = sinks.metrics_long(wide, "split").collect()
            return [(config.uid(), r["split"], r["metric"], r["value"]) for r in long]

        with ThreadPoolExecutor(parallelism) as pool:
            done = list(pool.map(inheritable_thread_target(spark)(one), list(configs)))
    flat = [row for part in done for row in part]
    return spark.createDataFrame(flat, "uid string, split string, metric string, value double")


def sweep_configs(matched: DataFrame, make) -> list[ProbeConfig]:
    """Configurations of the sweep rows that have an export; the others are skipped.

    A sweep is a few thousand rows by construction, so the list fits the driver.
    """
    return [make(row.asDict()) for row in matched.filter(F.col("export_path").isNotNull()).toLocalIterator()]


def best_layers(metric_rows: DataFrame, *by: str) -> DataFrame:
    """The best layer per group by the primary metric of the validation split."""
    wanted = metric_rows.filter((F.col("metric") == "primary_eval_metric") & (F.col("split") == "valid"))
    return metrics.best_per(wanted, "value", ["layer"], *by)


# --- saved probes -----------------------------------------------------------------------------


def _folder(root: str, config: ProbeConfig) -> str:
    return str(PurePosixPath(root) / config["dataset"] / config.uid()) if "://" not in root else "/".join(
        [root.rstrip("/"), config["dataset"], config.uid()]
    )


def save(spark: SparkSession, probe: Probe | NetworkProbe, root: str, valid_metrics: dict | None = None) -> str:
    """Write config, scaler, model and metrics under ``root/dataset/uid``; returns the uid."""
    folder = _folder(root, probe.config)
    sinks.save_json(spark, f"{folder}/cfg.json", dict(probe.config))
    sinks.save_json(spark, f"{folder}/scaler.json", {"means": probe.means, "deviations": probe.deviations})
    sinks.save_json(spark, f"{folder}/kind.json", {"model": type(probe.model).__name__, "output_type": probe.output_type})
    if isinstance(probe.model, Network):
        sinks.save_json(spark, f"{folder}/model.json", probe.model.to_json())
    else:
        probe.model.write().overwrite().save(f"{folder}/model")
    if valid_metrics is not None:
        sinks.save_json(spark, f"{folder}/metrics.json", valid_metrics)
    return probe.config.uid()


def load(spark: SparkSession, uid: str, root: str) -> Probe | NetworkProbe:
    """The saved probe whose uid starts with ``uid``; none is an error."""
    import json

    found = sinks.list_paths(spark, f"{root.rstrip('/')}/*/{uid}*/cfg.json").orderBy("path").first()
    if found is None:
        raise ValueError(f"no saved probe {uid}")
    folder = found["path"].rsplit("/", 1)[0]
    read = lambda name: json.loads(sinks.read_text(spark, f"{folder}/{name}.json"))
    scaler, kind = read("scaler"), read("kind")
    if kind["model"] == Network.__name__:
        found = Network.from_json(read("model"))
        return NetworkProbe(ProbeConfig(read("cfg")), found, scaler["means"], scaler["deviations"], kind["output_type"])
    model = _LOADERS[kind["model"]].load(f"{folder}/model")
    return Probe(ProbeConfig(read("cfg")), model, scaler["means"], scaler["deviations"])


def delete(spark: SparkSession, config: ProbeConfig, root: str, delete_metrics_and_config: bool = False) -> None:
    folder = _folder(root, config)
    names = ["model", "model.json", "scaler.json", "kind.json"]
    if delete_metrics_and_config:
        names += ["metrics.json", "cfg.json"]
    for name in names:
        sinks.delete(spark, f"{folder}/{name}")


def concept_output_type(concept: str) -> str:
    return "regression" if concept in fv.REGRESSION_CONCEPTS else "multiclass"

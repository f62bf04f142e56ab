"""A whole sweep: every configuration that has an export, grouped by the features it reads."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.functions.hashing import canonical_json
from gridprobe.operators import registry
from gridprobe.plans import probes, trainer
from gridprobe.sources import sinks
from gridprobe.sources.configs import ProbeConfig, probe_config

FEATURE_KEYS = ("concept", "model_type", "model_size", "model_layer")
HYPER = ("data_standardization", "hidden_layer_sizes", "batch_size", "learning_rate", "dropout_p", "l2_weight_decay")


def config_of(row: dict, seed: int = 0, **fixed) -> ProbeConfig:
    """The probe of a sweep row; parameters the sweep does not vary keep their defaults."""
    hyper = {name: row[name] for name in HYPER if row.get(name) is not None}
    return probe_config(*[row[k] for k in FEATURE_KEYS], seed=seed, num_classes=row.get("num_classes"), **hyper | fixed)


# Parameters that the solvers here do not have. Configurations that differ in nothing else are one fit.
WITHOUT_EFFECT = ("batch_size", "learning_rate", "dropout_p")


def effective(config: ProbeConfig, output_type: str) -> str:
    """A key that is equal for configurations with the same fit."""
    ignored = [*WITHOUT_EFFECT]
    if output_type == "regression":
        ignored.append("hidden_layer_sizes")
    elif config["hidden_layer_sizes"]:
        ignored.append("l2_weight_decay")
    return canonical_json({k: v for k, v in config.items() if k not in ignored})


def run_sweep(
    spark: SparkSession, rows: DataFrame, exports: DataFrame, load: Callable[[str, str, int], DataFrame],
    metrics_path: str, seed: int = 0, parallelism: int = 4, iterations: int | None = None, solver: str = "lbfgs", **fixed,
) -> DataFrame:
    """Fit and evaluate the sweep rows, append the metrics, and return those of this sweep.

    ``load(concept, export_path, layer)`` gives assembled rows. Configurations that read the same
    features share one persisted table, those that have the same fit share it, and every one gets its
    metrics. A group's metrics are stored when it is done, and configurations whose metrics are stored are
    not fitted again, so an interrupted sweep goes on and a finished one adds nothing. The sweep itself
    is a list of at most a few thousand rows; those without an export are skipped.

    With the solver "adam" every configuration is trained by ``plans/trainer.py``, all of a group in the same scans,
    and each of its settings acts. "lbfgs" fits by Spark ML, where some have no effect. ``fixed`` are further
    parameters that all probes have.
    """
    if solver not in ("lbfgs", "adam"):
        raise ValueError(f"unknown solver {solver}")
    matched = registry.match_exports(rows, exports).filter(F.col("export_path").isNotNull())
    listed = [r.asDict() for r in matched.orderBy(*FEATURE_KEYS).toLocalIterator()]
    known = set()
    if sinks.exists(spark, metrics_path):
        known = {r["uid"] for r in spark.read.parquet(metrics_path).select("uid").distinct().toLocalIterator()}
    uids = set()
    for key, group in groupby(listed, key=lambda r: (*[r[k] for k in FEATURE_KEYS], r["export_path"])):
        concept, family, size, layer, path = key
        configs = {c.uid(): c for c in (config_of(r, seed, **fixed) for r in group)}
        uids |= set(configs)
        output_type = probes.concept_output_type(concept)
        same_fit: dict[str, list[str]] = {}
        for uid, config in sorted(configs.items()):
            if uid not in known:
                same_fit.setdefault(uid if solver == "adam" else effective(config, output_type), []).append(uid)
        if not same_fit:
            continue
        assembled, fitted = load(concept, path, layer), [configs[u[0]] for u in same_fit.values()]
        if solver == "adam":
            done = trainer.metric_rows(spark, trainer.train(assembled, fitted, output_type))
        else:
            done = probes.sweep(assembled, fitted, output_type, parallelism, iterations)
        fanned = spark.createDataFrame([(u[0], uid) for u in same_fit.values() for uid in u], "uid string, each string")
        tagged = done.join(F.broadcast(fanned), "uid").select(
            F.lit(concept).alias("concept"), F.lit(family).alias("model_type"), F.lit(size).alias("model_size"),
            F.lit(layer).alias("layer"), F.col("each").alias("uid"), "split", "metric", "value",
        )
        sinks.append_metrics(tagged, metrics_path)
    mine = spark.createDataFrame([(u,) for u in sorted(uids)], "uid string")
    return spark.read.parquet(metrics_path).join(F.broadcast(mine), "uid", "left_semi")

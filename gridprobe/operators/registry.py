"""Which stored embedding a probe configuration reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridprobe.functions import dims
from gridprobe.functions import fixed_values as fv
from gridprobe.functions.literals import literal_map
from gridprobe.operators.small import broadcast_if_small


def model_size(model_name: Column) -> Column:
    """``L`` unless the name ends in ``_LM_<size>``."""
    decoder = F.contains(model_name, F.lit(fv.DECODER_FAMILY))
    tail = F.element_at(F.split(model_name, "_LM_"), -1)
    return F.when(decoder, tail).otherwise(F.lit("L"))


def model_family(model_name: Column) -> Column:
    decoder = F.contains(model_name, F.lit(fv.DECODER_FAMILY))
    return F.when(decoder, F.lit(fv.DECODER_FAMILY)).otherwise(model_name)


def family_key(family: Column) -> Column:
    """Decoder families compare without their ``_LM`` suffix, all others as they are."""
    bare = F.split(family, "_LM")[0]
    return F.when(F.startswith(family, F.lit(fv.DECODER_FAMILY)), bare).otherwise(family)


def max_layers(model_name: Column) -> Column:
    """Layers of a known model; NULL for models with one vector per sample."""
    return F.try_element_at(literal_map(fv.MODEL_LAYERS), model_name)


def export_hash(file_name: Column) -> Column:
    """The model hash: the text after the last underscore, before the extension."""
    return F.regexp_extract(F.split(file_name, r"\.")[0], r"([^_]*)$", 1)


def list_exports(paths: DataFrame, configs: DataFrame, concept: str, path: str = "path") -> DataFrame:
    """Exports of a concept with their model: names must start with the concept.

    ``configs`` has (model_hash, model_name, shape array<int>); size and family derive from the name.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    named = paths.withColumn("file_name", name).filter(F.startswith(name, F.lit(concept)))
    hashed = named.withColumn("model_hash", export_hash(F.col("file_name")))
    return hashed.join(configs, "model_hash").withColumns({
        "concept": F.lit(concept),
        "model_size": model_size(F.col("model_name")), "model_type": model_family(F.col("model_name")),
    })


def match_exports(configs: DataFrame, exports: DataFrame) -> DataFrame:
    """Add to each (concept, model_size, model_type, model_layer) the last path, by name, among the concept's
    exports that have more than that many layers; NULL if there is none.

    The layer test is an inequality, but no pair of rows is ever formed for it: exports fold to one
    path per (size, family, layer count), a running maximum from the deepest down answers each layer,
    and the answers join on equality. A configuration's layers are far fewer than its rows.
    """
    folded = (
        exports.withColumn("_f", family_key(F.col("model_type")))
        .groupBy(F.col("concept").alias("_c"), F.col("model_size").alias("_s"), "_f", F.col("n_layers").alias("_n"))
        .agg(F.max("path").alias("_p"))
    )
    deepest_first = Window.partitionBy("_c", "_s", "_f").orderBy(F.desc("_n"))
    shallower = F.coalesce(F.lead("_n").over(deepest_first), F.lit(0))
    answers = folded.withColumns({
        "export_path": F.max("_p").over(deepest_first.rowsBetween(Window.unboundedPreceding, 0)),
        "_from": shallower,
    }).filter("_n > _from")
    by_layer = answers.select(
        "_c", "_s", "_f", "export_path", F.explode(F.sequence(F.col("_from"), F.col("_n") - 1)).alias("_l")
    )
    keyed = configs.withColumn("_k", family_key(F.col("model_type")))
    matched = keyed.join(
        broadcast_if_small(by_layer),
        (F.col("concept") == F.col("_c")) & (F.col("model_size") == F.col("_s")) & (F.col("_k") == F.col("_f")) & (F.col("model_layer") == F.col("_l")),
        "left",
    )
    return matched.drop("_k", "_c", "_s", "_f", "_l")


def task_targets(df: DataFrame, concept: str) -> DataFrame:
    """Add what a probe of each concept predicts: label column, output type and output count."""
    first = dims.concept_labels(df.sparkSession).filter("ordinal = 0").drop("ordinal")
    named = first.withColumnsRenamed({"concept": concept, "column": "label_column"})
    regression = F.col(concept).isin(*fv.REGRESSION_CONCEPTS)
    return df.join(F.broadcast(named), concept, "left").withColumns({
        "output_type": F.when(regression, "regression").otherwise("multiclass"),
        "num_outputs": F.when(regression, F.lit(1)).otherwise(F.col("num_classes")),
    }).drop("num_classes")

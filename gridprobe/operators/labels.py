"""Label domains, codes and one-hot vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.functions import vectors
from gridprobe.operators.ranks import with_dense_index
from gridprobe.operators.small import SMALL_ROWS as SMALL_DOMAIN


def domain(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def small_domain(df: DataFrame, column: str, limit: int = SMALL_DOMAIN) -> list | None:
    """The sorted classes, or None if there are more than ``limit``."""
    values = [r[0] for r in domain(df, column).orderBy(column).limit(limit + 1).collect()]
    return values if len(values) <= limit else None


def encode(df: DataFrame, column: str, name: str | None = None, limit: int = SMALL_DOMAIN) -> DataFrame:
    """Add the 0-based place of each value among the sorted distinct values.

    A small domain is broadcast. A large one is numbered with a range shuffle and joined without a
    hint; its side has one row per value, so a hot value only splits the other side.
    """
    name = name or f"{column}_encoded"
    values = small_domain(df, column, limit)
    if values is None:
        codes = with_dense_index(domain(df, column), column, name=name)
        return df.join(codes.withColumn(name, F.col(name).cast("int")), column, "left")
    kind = df.schema[column].dataType
    codes = df.sparkSession.createDataFrame(
        [(v, i) for i, v in enumerate(values)], f"`{column}` {kind.simpleString()}, `{name}` int"
    )
    return df.join(F.broadcast(codes), column, "left")


def one_hot(df: DataFrame, column: str, coded: str | None = None) -> DataFrame:
    """Add ``<column>_ohe``: a float vector in sorted class order, as long as there are classes.

    ``coded`` names a column that has the codes already.
    """
    ready = df if coded else encode(df, column, "_code")
    code = coded or "_code"
    # One number, whatever the size of the domain; the highest code is its last class.
    size = ready.agg(F.coalesce(F.max(code) + 1, F.lit(0))).first()[0]
    shown = ready.withColumn(f"{column}_ohe", vectors.one_hot(F.col(code), size))
    return shown if coded else shown.drop("_code")


def format_labels(df: DataFrame, column: str, output_type: str) -> DataFrame:
    """Regression labels are scaled to [0, 1]; class labels get codes and one-hot vectors."""
    from gridprobe.operators.scaling import min_max

    if output_type == "regression":
        return min_max(df, column, column)
    if output_type == "multiclass":
        return one_hot(encode(df, column), column, f"{column}_encoded")
    raise ValueError(f"Unsupported output type: {output_type}")


def class_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct values per named label column, in one pass: (label, n_classes).

    Each row spreads into one short record per label, and the partial aggregation folds them back to
    the domain before anything is shuffled.
    """
    records = F.array(
        *[F.struct(F.lit(n).alias("label"), F.col(c).cast("string").alias("value")) for n, c in columns.items()]
    )
    pairs = df.select(F.explode(records).alias("r")).select("r.*").distinct()
    return pairs.groupBy("label").agg(F.count("value").alias("n_classes"))


def split_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("split", column).agg(F.count(F.lit(1)).alias("n"))

"""Datasets from a user's own rows and row processor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

from gridprobe.sources import sinks

# (row_id, record) in, any number of (row_id, record) out.
RowProcessor = Callable[[tuple[int, dict]], list[tuple[int, dict]]]


def process_rows(rows: DataFrame, processor: RowProcessor, schema: str, row_id: str = "row_id") -> DataFrame:
    """Run a processor over every row; each may give several rows, and an error fails the job.

    ``schema`` describes the output without the row id. Use column expressions where they can say it:
    this path moves every row through Python, in batches.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            made = []
            for record in batch.to_dict("records"):
                for new_id, columns in processor((record.pop(row_id), record)):
                    made.append({row_id: new_id, **columns})
            if made:
                yield pd.DataFrame(made)

    return rows.mapInPandas(run, f"{row_id} bigint, {schema}")


# The columns a processor makes, from those it is given and the constant arguments of the call.
Outputs = Callable[..., StructType]


def table_function(processor: Callable, outputs: Outputs, row_id: str = "row_id") -> UserDefinedTableFunction:
    """A row processor as a table function, for SQL and lateral joins: ``SELECT * FROM name(TABLE(rows), key => value)``.

    ``processor((row_id, record), **constants)`` gives (row_id, record) rows. ``outputs(columns, **constants)`` says which
    columns it makes, without the row id, so the schema of a call follows from its arguments when the query is analysed. Arguments
    besides the table must be constants with names. A record that lacks a column has NULL there; one with a column that was
    not announced, and a table without a row id, are errors. Rows are processed where they are, without a shuffle; a NULL row id or
    NULL columns are handed to the processor as None.
    """

    class Processed:
        def __init__(self, analysis: AnalyzeResult):
            self.names = analysis.schema.fieldNames()[1:]

        @staticmethod
        def analyze(rows: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or row_id not in rows.dataType.fieldNames():
                raise ValueError(f"the first argument must be a table with a column {row_id}")
            if changing := [name for name, argument in named.items() if not argument.isConstantExpression]:
                raise ValueError(f"{', '.join(changing)} must be constant")
            given = StructType([f for f in rows.dataType.fields if f.name != row_id])
            made = outputs(given, **{name: argument.value for name, argument in named.items()})
            return AnalyzeResult(StructType([StructField(row_id, LongType()), *made.fields]))

        def eval(self, row, **constants):  # noqa: ANN001
            record = row.asDict(recursive=True)
            for new_id, columns in processor((record.pop(row_id), record), **constants):
                if unknown := sorted(set(columns) - set(self.names)):
                    raise ValueError(f"columns {', '.join(unknown)} were not announced")
                yield (new_id, *[columns.get(name) for name in self.names])

    return udtf(Processed)


def process_rows_sql(rows: DataFrame, function: UserDefinedTableFunction, **constants) -> DataFrame:
    """Call a table function over a DataFrame."""
    return function(rows.asTable(), **{name: F.lit(value) for name, value in constants.items()})


def check_unique_ids(df: DataFrame, row_id: str = "row_id") -> None:
    """Fail if a row id repeats."""
    repeated = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if repeated is not None:
        raise ValueError(f"row id {repeated[row_id]} occurs {repeated['n']} times")


def create_dataset(rows: DataFrame, processor: RowProcessor, schema: str, path: str) -> DataFrame:
    """Process rows and publish the result once, ordered by row id; a failing row leaves nothing."""
    if sinks.exists(rows.sparkSession, path):
        raise RuntimeError(f"a table exists already at {path}")
    sinks.publish(process_rows(rows, processor, schema), path, check=check_unique_ids)
    return rows.sparkSession.read.schema(f"row_id bigint, {schema}").parquet(path)

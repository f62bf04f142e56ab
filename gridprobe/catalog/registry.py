"""The list of queries and the text helpers their SQL shares."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.functions import dims
from gridprobe.functions import fixed_values as fv
from gridprobe.sources import tables


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function (spark, folder) under its own name; ``operators`` lists inventory ids."""

    def add(run):
        name = run.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(name, tuple(operators.split()), run, sql)
        return run

    return add


def reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: tables.table(spark, folder, name)


def csv(values: Column) -> Column:
    """An array as comma-separated text."""
    return F.concat_ws(",", values.cast("array<string>"))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


# --- SQL text --------------------------------------------------------------------------------


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(lit(v) for v in value) + "]"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return repr(value)


def values(name: str, columns: str, rows) -> str:
    """A common table expression of literal rows."""
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def nth(items, ordinal: str) -> str:
    """The literal list entry at a 0-based ordinal."""
    return f"({lit(list(items))})[({ordinal}) + 1]"


MODES = values("modes", "mode_ord, mode, offs", [(i, m, o) for i, (m, o) in enumerate(fv.MODE_OFFSETS.items())])
INSTRUMENTS = values("instruments", "category, program, name", dims.instrument_rows())
PITCHED = values(
    "pitched", "inst_ord, category, program, name",
    [(i, *row) for i, row in enumerate(dims.pitched_instrument_rows())],
)
CLICKS = values(
    "clicks", "click_ord, channel, program, down, off, name, down_vel, off_vel",
    [(i, *row) for i, row in enumerate(fv.CLICK_CONFIGS)],
)
SHARPS = lit(list(fv.SHARP_NAMES))
MODE_NAMES = list(fv.MODE_OFFSETS)


def tonic_sql(pc: str) -> str:
    return f"(CASE WHEN {pc} <= 5 THEN 60 + {pc} ELSE 48 + {pc} END)"


def hash_sql(seed: int, *parts: str) -> str:
    """The seeded row key: 15 hexadecimal digits of an MD5."""
    text = " || ':' || ".join(["'%d'" % seed] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def unit_sql(seed: int, *parts: str) -> str:
    text = " || ':' || ".join(["'%d'" % seed] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"

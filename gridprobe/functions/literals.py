"""Literal columns from Python values.

One SQL expression per value: a list of a hundred records costs one call to the session instead of
hundreds, and folds to a single constant in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple, range)):
        return "array(" + ", ".join(sql_text(v) for v in value) + ")"
    return str(value)


def literal(value) -> Column:
    return F.expr(sql_text(value))


def literal_records(records, fields) -> Column:
    """An array of structs with the given field names."""
    rows = [
        "named_struct(" + ", ".join(f"{sql_text(f)}, {sql_text(v)}" for f, v in zip(fields, r)) + ")" for r in records
    ]
    return F.expr("array(" + ", ".join(rows) + ")")


def map_text(mapping: dict) -> str:
    return "map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in mapping.items()) + ")"


def literal_map(mapping: dict) -> Column:
    return F.expr(map_text(mapping))

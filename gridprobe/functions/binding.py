"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A plain column expression that is used inside a lambda runs again for every element, which makes
    row-local work quadratic. Bound to a lambda variable it runs once per row.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]

"""Registered queries: each operator over the given tables, with the SQL it must agree with."""

from __future__ import annotations

from gridprobe.catalog import (  # noqa: F401  (importing a module registers its queries)
    grids,
    jobs,
    labelling,
    probing,
    scoring,
    sequencing,
    signals,
    theory,
)
from gridprobe.catalog.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]

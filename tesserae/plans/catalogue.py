"""Queries of the engine's own operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from tesserae.plans import files, imaging, measuring, metrics, ranking, scalars, spatial  # noqa: F401  they fill the register
from tesserae.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

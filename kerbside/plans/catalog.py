"""Every query of this package."""

from __future__ import annotations

from . import aggregates, composites, functions, graphs, joins, scalars, sequences, sources, streams
from .registry import oracle_sql, queries

MODULES = (sources, scalars, joins, aggregates, sequences, graphs, streams, composites, functions)

__all__ = ["MODULES", "oracle_sql", "queries"]

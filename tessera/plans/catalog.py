"""All queries of the change-set operators, and their SQL."""

from __future__ import annotations

from . import more_oracles, more_queries, oracles, queries

QUERIES = {**queries.QUERIES, **more_queries.QUERIES}
ORACLES = {**oracles.ORACLES, **more_oracles.ORACLES}

__all__ = ["ORACLES", "QUERIES"]

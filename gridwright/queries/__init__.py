"""Registered queries: each with the operators it applies and, where SQL can express it, an oracle in DuckDB's SQL."""

from __future__ import annotations

from gridwright.queries.registry import ORACLE_SQL, QUERIES  # noqa: F401
from gridwright.queries import expressions, relational, spatial, graphs, sizing, statistics, storage, extras  # noqa: E402,F401,I001

"""Queries of the error-control engine, by operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from wardstream.plans import oracles, ref_control, ref_relational, ref_sources

QUERIES: dict = ref_relational.QUERIES | ref_control.QUERIES | ref_sources.QUERIES
SQL: dict = ref_relational.SQL | ref_control.SQL | oracles.SQL | ref_sources.SQL

"""All queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ["wardstream.plans.problems", "wardstream.plans.reference"]


def _modules() -> list:
    return [importlib.import_module(m) for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.SQL.items()}

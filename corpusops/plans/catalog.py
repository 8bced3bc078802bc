"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import importlib


PARTS = ["files", "columns", "relations", "evaluations", "mixes"]


def _modules() -> list:
    return [importlib.import_module(f"corpusops.plans.{p}") for p in PARTS]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.R.sql.items()}



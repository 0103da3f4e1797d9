"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("rows", "catalog", "schema_health", "governance", "histories", "replicas", "files")


def queries() -> dict:
    return {k: f for m in FAMILIES for k, f in import_module(f"tidewright.plans.{m}").registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in FAMILIES for k, s in import_module(f"tidewright.plans.{m}").registry.sql.items()}

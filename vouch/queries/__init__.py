"""All registered queries and their DuckDB twins, merged by area."""

from __future__ import annotations

from importlib import import_module

_AREAS = ["contracts", "datasets", "namespaces", "fanout", "streams"]


def all_queries() -> dict:
    out: dict = {}
    for area in _AREAS:
        out.update(import_module(f"vouch.queries.{area}").QUERIES)
    return out


def all_oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for area in _AREAS:
        out.update(import_module(f"vouch.queries.{area}").ORACLE)
    return out

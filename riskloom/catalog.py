"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("explorer", "ingest", "detection", "baseline", "learning", "daily", "training", "sequences", "exports")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"riskloom.plans.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")

"""Queries of an area by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register the decorated ``(spark, sf_dir) -> DataFrame``; without SQL where SQL can't express it."""

        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add

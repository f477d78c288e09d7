"""Expressions that are built once: what a function adds to a frame, kept for frames of the same columns and types.

Thousands of expressions cost more to build than to run. A function that only adds and drops columns, by names and types alone, is run
over a stand-in that notes what it adds; the notes are then applied to any frame with those columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame


class Noted:
    """A stand-in for a frame: its columns with their types ('' where one has been added), and the steps so far."""

    def __init__(self, dtypes: list[tuple[str, str]], steps: tuple = ()):
        self.dtypes, self.steps = dtypes, steps

    @property
    def columns(self) -> list[str]:
        return [n for n, _ in self.dtypes]

    def withColumns(self, added: dict[str, Column]) -> Noted:  # noqa: N802  named as a frame's
        kept = [(n, "" if n in added else t) for n, t in self.dtypes]
        return Noted(kept + [(n, "") for n in added if n not in self.columns], (*self.steps, ("withColumns", (dict(added),))))

    def withColumn(self, name: str, column: Column) -> Noted:  # noqa: N802
        return self.withColumns({name: column})

    def drop(self, *names: str) -> Noted:
        return Noted([(n, t) for n, t in self.dtypes if n not in names], (*self.steps, ("drop", names)))


def planned(f: Callable) -> Callable:
    """``f(df)`` with its expressions built once for each set of columns and types."""
    kept: dict[tuple, tuple] = {}

    @wraps(f)
    def run(df: DataFrame | Noted):
        if isinstance(df, Noted):
            return f(df)
        key = (id(SparkContext._gateway), *df.dtypes)
        if key not in kept:
            kept[key] = f(Noted(df.dtypes)).steps
        for name, args in kept[key]:
            df = getattr(df, name)(*args)
        return df

    return run

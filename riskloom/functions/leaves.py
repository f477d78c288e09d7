"""What JSON bodies of any depth hold, flat, in Arrow batches."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def objects(bodies):
    for body in bodies:
        try:
            yield json.loads(body)
        except (TypeError, ValueError):
            yield None


def leaves(body: dict, inside):
    """(path, value) of all that ``inside`` doesn't open, in order; ``inside(value)`` gives the (name, value) of what it opens."""
    todo = [((), body)]
    while todo:
        path, value = todo.pop()
        entries = inside(value)
        if entries is None:
            yield path, value
        else:
            todo += [((*path, name), x) for name, x in entries][::-1]


_SEPARATORS = str.maketrans(" .-", "___")


def _columns(value):
    """Objects open, but for hidden names, and so do lists of other than plain values, by number."""
    if isinstance(value, dict):
        return [(name.strip().translate(_SEPARATORS), x) for name, x in value.items() if name[:1] != "_"]
    if isinstance(value, list) and any(x is None or isinstance(x, (dict, list)) for x in value):
        return list(enumerate(value))
    return None


def _cell(value) -> str:
    return "" if value is None else ";".join(map(str, value)) if isinstance(value, list) else str(value)


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def flatten(bodies: pa.Array) -> pa.Array:
    """A body of any depth as one level: names joined by '_', scalar lists by ';', names that begin with '_' left out."""
    flat = ({"_".join(map(str, path)): _cell(v) for path, v in leaves(x, _columns)} if isinstance(x, dict) else {} for x in objects(bodies.to_pylist()))
    return pa.array([list(x.items()) for x in flat], pa.map_(pa.string(), pa.string()))

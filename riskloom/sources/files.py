"""Exports as files and files as tables: CSV with a header, or a JSON object a line, one file a task.

Null and empty text stay apart in both; texts may hold quotes, commas and line ends. CSV files are read whole
by a task each, since a quoted text may span lines; JSON lines are split. In CSV null is an empty field and empty
text a quoted one; while reading, the noncharacter U+FFFF stands for the latter, so a text of this character alone reads as empty.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How times are spelled in exports.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_CSV = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""', "lineSep": "\n"}
KINDS = ("csv", "ndjson")
_EMPTY = "\uffff"


def _kind(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")


def write_rows(df: DataFrame, folder: str, kind: str) -> None:
    """Write a new folder; an existing one is an error. An empty table still leaves its header or an empty file."""
    _kind(kind)
    if kind == "csv":
        df.write.options(**_CSV, **TIMES, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(folder)
    else:
        df.write.options(**TIMES, ignoreNullFields="false").json(folder)


def read_rows(spark: SparkSession, folder: str, kind: str, schema) -> DataFrame:
    """The rows of such a folder; a row that does not fit ``schema`` is an error, never a row of nulls."""
    _kind(kind)
    reader = spark.read.schema(schema).options(**TIMES, mode="FAILFAST")
    if kind == "csv":
        rows = reader.options(**_CSV | {"emptyValue": _EMPTY}, multiLine="true", enforceSchema="false").csv(folder)
        return rows.select(*(F.when(F.col(f"`{f.name}`") != _EMPTY, F.col(f"`{f.name}`")).when(F.col(f"`{f.name}`") == _EMPTY, "").alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in rows.schema))
    return reader.json(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as it names it; one of our own only where none is named and all tasks run in this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="spark-")).rstrip("/")

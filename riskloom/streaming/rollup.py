"""Minute rollups in slices of time that can be broken off and taken up again.

A slice is rolled up whole and replaces what it had before (dynamic partition overwrite), is read back and counted against its source, and only then
noted as finished with its count. Slices whose source has other rows than were noted, by late arrivals or because they were never finished, are done again:
the result is that of one pass, however often and in whatever order it runs.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.explorer import minute_rollup
from riskloom.streaming.archive import _exists

_FINISHED = "slice timestamp_ntz, events long, stamp long, number long"


def slices(source: DataFrame, minutes: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """(slice, events, stamp) of the source: distinct ids and a sum of their hashes, so that an exchange of rows shows too."""
    at = F.window(F.col(ts), f"{minutes} minutes")["start"].alias("slice")
    ids = source.select(at, key).distinct()
    return ids.groupBy("slice").agg(F.count("*").alias("events"), F.sum(F.pmod(F.xxhash64(key), F.lit(1 << 32))).alias("stamp"))


def finished(spark: SparkSession, root: str) -> DataFrame:
    """(slice, events, stamp) as last noted."""
    if not _exists(spark, f"{root}/finished"):
        return spark.createDataFrame([], _FINISHED).drop("number")
    noted = spark.read.schema(_FINISHED).parquet(f"{root}/finished")
    return noted.groupBy("slice").agg(F.max_by(F.struct("events", "stamp"), "number").alias("n")).select("slice", "n.*")


def pending(source: DataFrame, root: str, minutes: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """(slice, events, stamp) of the slices that have to be rolled up; what has lost all its rows has none."""
    want, have = slices(source, minutes, ts, key), finished(source.sparkSession, root)
    return want.join(have, ["slice", "events", "stamp"], "left_anti")


def roll_up(source: DataFrame, root: str, dims: list[str], minutes: int = 60, at_once: int = 24, ts: str = "ts", key: str = "event_id") -> int:
    """Roll up every pending slice, ``at_once`` of them in a job; how many there were."""
    spark, done = source.sparkSession, 0
    at = F.window(F.col(ts), f"{minutes} minutes")["start"]
    while True:
        due = pending(source, root, minutes, ts, key).orderBy("slice").limit(at_once).collect()
        if not due:
            return done
        names = [r.slice for r in due]
        part = source.where((F.col(ts) >= F.lit(min(names))) & at.isin(names))
        made = minute_rollup(part, dims, ts, key).withColumn("slice", F.date_format(F.window("minute", f"{minutes} minutes")["start"], "yyyyMMddHHmm"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(f"{root}/minutes")
        counted = {r.slice: (r.events, r.stamp) for r in slices(spark.read.parquet(f"{root}/minutes").where(F.col("minute") >= F.lit(min(names))), minutes, "minute", key).where(F.col("slice").isin(names)).collect()}
        short = [r.slice for r in due if counted.get(r.slice, (0, 0)) != (r.events, r.stamp)]
        if short:
            raise ValueError(f"the rollup differs from its source in the slice of {short[0]}: run again from there")
        number = finished_number(spark, root)
        notes = spark.createDataFrame([(r.slice, r.events, r.stamp, number) for r in due], _FINISHED)
        notes.coalesce(1).write.mode("append").parquet(f"{root}/finished")
        done += len(due)


def finished_number(spark: SparkSession, root: str) -> int:
    """A number higher than all notes have: the last one of a slice counts."""
    if not _exists(spark, f"{root}/finished"):
        return 1
    return (spark.read.schema(_FINISHED).parquet(f"{root}/finished").agg(F.max("number")).first()[0] or 0) + 1


def minutes(spark: SparkSession, root: str) -> DataFrame:
    """The rollup: a row for each minute, dimensions and id."""
    return spark.read.parquet(f"{root}/minutes").drop("slice")

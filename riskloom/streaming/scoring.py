"""Snapshots scored as they come: each micro-batch continues from the states that the ones before it have left.

A batch reads the newest state of its own users, cohorts and hosts among all batches before it, scores its rows by the fixed point of
``operators.learning``, and writes rows and the states of those entities to folders of its number. One that is broken off and runs again reads the same
states and replaces what it had written. Within a batch the order of arrival counts; batches follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import learning as L
from riskloom.streaming.archive import _exists

_KEPT = L.STATES + ", batch long"


def states(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(kind, entity, state) as the last batch that met an entity has left it; of the batches before one, if asked for."""
    if not _exists(spark, f"{root}/states"):
        return spark.createDataFrame([], L.STATES)
    rows = spark.read.schema(_KEPT).option("basePath", f"{root}/states").parquet(f"{root}/states")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("kind", "entity").agg(F.max_by("state", "batch").alias("state"))


def take(batch: DataFrame, number: int, root: str, score: Callable[[DataFrame], DataFrame], users: tuple[str, ...], hosts: tuple[str, ...]) -> None:
    """One micro-batch of snapshots with their features into ``root``: scored, states."""
    spark = batch.sparkSession
    batch = batch.persist()  # the fixed point reads it every round
    met = [batch.select(F.lit(kind).alias("kind"), F.trim(c).alias("entity")) for kind, c in (("user", "username"), ("role", "role_name"), ("host", "agent_id"))]
    met = met[0].unionByName(met[1]).unionByName(met[2]).distinct()
    known = states(spark, root, number).join(met, ["kind", "entity"], "left_semi")
    scored, after, _ = L.learn(batch, score, users, hosts, known)
    scored.write.mode("overwrite").parquet(f"{root}/scored/batch={number}")
    after.write.mode("overwrite").parquet(f"{root}/states/batch={number}")
    batch.unpersist()


def start(stream: DataFrame, root: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], users: tuple[str, ...] = L.USER_FEATURES, hosts: tuple[str, ...] = L.HOST_FEATURES, **trigger):
    """Start the query: snapshots of ``stream`` (as ``learning.learn`` takes them) scored into ``root``."""
    return stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, root, score, users, hosts)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()

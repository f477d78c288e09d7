"""Endpoints: hygiene of host names, presence, discovery over sources, risk counts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import content as C
from riskloom.functions.identity import BLANKS
from riskloom.operators.explorer import latest
from riskloom.sources.files import shared_folder


def clean_host(host: Column) -> Column:
    """Trimmed; null where it is empty or a load test's."""
    name = F.btrim(host, F.lit(BLANKS))
    return F.when((name != "") & ~F.lower(name).startswith("loadtest-"), name)


def presence(agents: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """Each host (names without regard to case) with its last sign of life, not later than now, and its status."""
    named = agents.withColumn("host", clean_host(F.col("hostname"))).where("host is not null")
    seen = named.groupBy(F.lower("host").alias("key")).agg(F.max("host").alias("hostname"), F.least(F.max("last_seen_at"), as_of).alias("last_seen_at"))
    online = F.coalesce(F.col("last_seen_at") > as_of - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))
    return seen.select("hostname", "last_seen_at", F.when(online, "online").otherwise("offline").alias("status"))


def presence_counts(hosts: DataFrame) -> DataFrame:
    return hosts.agg(F.count("*").alias("total_pcs"), F.count_if(F.col("status") == "online").alias("online_pcs"), F.count_if(F.col("status") != "online").alias("offline_pcs"))


def discover(sources: list[DataFrame], last: DataFrame | None = None) -> DataFrame:
    """Agents of all sources(agent_id, hostname, seen_at): the newest host of each, first and last seen. ``last`` is looked at only if the others have nobody."""
    every = reduce(lambda a, b: a.unionByName(b), sources).where("agent_id is not null")
    if last is not None and not every.limit(1).count():
        every = last.where("agent_id is not null")
    return every.groupBy(F.lower("agent_id").alias("key")).agg(
        F.max("agent_id").alias("agent_id"), F.max_by("hostname", F.struct("seen_at", "hostname")).alias("hostname"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")
    ).drop("key")


def is_test(agent: Column, signals: Column, test_agents: list[str]) -> Column:
    return agent.isin(*test_agents) | (F.coalesce(F.get_json_object(signals, "$.source_kind"), F.lit("")) == "synthetic_test")


def annotate(risk: DataFrame, as_of: Column) -> DataFrame:
    """Scored events with level, and with score and level as far as they are active."""
    active = C.is_active(F.col("created_at"), as_of)
    return risk.withColumns({"risk_level": C.level(F.col("risk_score")), "is_active": active}).withColumns(
        {"active_risk_score": F.when(active, F.col("risk_score")).otherwise(0.0), "active_risk_level": F.when(active, F.col("risk_level")).otherwise("LOW")}
    )


def risk_counts(agents: DataFrame, risk: DataFrame, as_of: Column, test_agents: list[str]) -> DataFrame:
    """Hosts that are not only tests' by the level of their latest event as far as it is active; without one LOW."""
    test = agents.where(F.col("agent_id").isin(*test_agents)).select(F.lower("hostname").alias("h"))
    normal = agents.where(~F.col("agent_id").isin(*test_agents))
    newest = annotate(latest(risk.select("agent_id", "risk_id", "risk_score", "created_at"), ["agent_id"], ["created_at", "risk_id"]), as_of)
    only = test.join(normal.select(F.lower("hostname").alias("h")), "h", "left_anti")
    hosts = normal.withColumn("h", F.lower("hostname")).join(only, "h", "left_anti").groupBy("h").agg(F.min("agent_id").alias("agent_id"))
    met = hosts.join(newest.select("agent_id", "active_risk_level"), "agent_id", "left")
    return met.groupBy(F.coalesce("active_risk_level", F.lit("LOW")).alias("level")).agg(F.count("*").alias("hosts"))


def nearest_rank(rows: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, p50, ...): of each group the value at place int(n q) (the last at most) of its values in order.

    Equal values are counted first. Ranges of (group, value) are dealt to tasks, whose totals (a row a range and group) say where a range begins,
    so a group of any number of different values is many tasks' work. Null values have no place.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__c"))
    dealt = counted.repartitionByRange(by, value).withColumn("__part", F.spark_partition_id())
    path = f"{shared_folder(rows.sparkSession)}/ranks-{uuid.uuid4().hex[:12]}"  # ranges must not move between the two readings
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    parts = dealt.groupBy(by, "__part").agg(F.sum("__c").alias("__rows"))
    group = Window.partitionBy(by)
    parts = parts.select(F.col(by).alias("__by"), F.col("__part").alias("__of"), F.sum("__rows").over(group.orderBy("__part")).alias("__upto"), F.sum("__rows").over(group).alias("__n"), "__rows")
    met = dealt.join(F.broadcast(parts), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__of")))
    upto = F.sum("__c").over(Window.partitionBy("__part", by).orderBy(value)) + F.col("__upto") - F.col("__rows")
    ranked = met.withColumn("__to", upto)
    place = lambda q: F.least(F.col("__n") - 1, F.floor(F.col("__n") * q))
    return ranked.groupBy(by).agg(*(F.min(F.when(F.col("__to") > place(q), F.col(value))).alias(f"p{int(q * 100)}") for q in shares))

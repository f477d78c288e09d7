"""Scores against what earlier snapshots have taught, and what they have taught. A fixed point is beyond SQL: tests hold it against a walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import learning as L
from riskloom.plans import baseline, detection
from riskloom.plans.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _arrivals(spark, sf_dir):
    """Snapshots in the order in which they came: by their number, while an eighth of them was seen an hour or a day and a half before. Rules look at a snapshot alone: they are told once, not in every round."""
    seen = baseline._seen(spark, sf_dir)
    back = F.expr("case payload_id % 16 when 3 then interval 1 hours when 11 then interval 36 hours else interval 0 hours end")
    return detection.ruled(seen.withColumns({"arrived": F.col("ts"), "ts": F.col("ts") - back}))


@R.query("learned_risk")
def learned_risk(spark, sf_dir):
    """Every snapshot's risk against the baselines that the calm ones before it have taught, and how far its user's and host's values lie from them."""
    scored, _, _ = L.learn(_arrivals(spark, sf_dir), detection.scored_against, felt=detection.FELT)
    return scored.select("payload_id", "username", "agent_id", F.round("risk_score", 6).alias("risk_score"), "risk_level", "burst", *(F.round(c, 6).alias(c) for c in scored.columns if c.startswith(("z_", "host_z_"))))


@R.query("learned_baselines")
def learned_baselines(spark, sf_dir):
    """What users, cohorts and hosts have learnt after all snapshots: mean, deviation and merged days of each feature."""
    _, states, _ = L.learn(_arrivals(spark, sf_dir), detection.scored_against, felt=detection.FELT, whole=False)
    held = F.from_json("state", "mean map<string,double>, std map<string,double>, samples map<string,long>, taken long")
    rows = states.select("kind", "entity", held.alias("s")).select("kind", "entity", F.col("s.taken").alias("taken"), F.explode("s.mean").alias("feature", "mean"), "s.std", "s.samples")
    return rows.select("kind", "entity", "feature", F.round("mean", 6).alias("mean"), F.round(F.col("std")[F.col("feature")], 6).alias("std"), F.col("samples")[F.col("feature")].alias("samples"), "taken")

"""Queries of exports to files and back, detectors from outside, and feature extremes."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import detectors as D
from riskloom.plans.registry import Registry
from riskloom.plans.sequences import _shared as new_folder
from riskloom.sources import files
from riskloom.sources.views import bodies, observations, risk_events, with_sql

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _round_trip(spark, df, kind):
    folder = new_folder(spark)
    files.write_rows(df, folder, kind)
    return files.read_rows(spark, folder, kind, df.schema)


# -- files -----------------------------------------------------------------------------------------


@R.query("export_logs_csv", f"""{with_sql('bodies')} select event_id as id, ts as collected_at, agent_id, hostname, username, collector, status,
  case when status = 'failed' then null when event_id % 10 = 0 then '' else body || chr(10) || '"x", y' end as payload_json from bodies""")
def export_logs_csv(spark, sf_dir):
    """All logs as CSV, read again; some payloads are null, some empty, the others have line ends, quotes and commas."""
    text = F.when(F.col("status") == "failed", None).when(F.col("event_id") % 10 == 0, "").otherwise(F.concat("body", F.lit('\n"x", y')))
    rows = bodies(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts").alias("collected_at"), "agent_id", "hostname", "username", "collector", "status", text.alias("payload_json"))
    return _round_trip(spark, rows, "csv")


@R.query("export_threats_ndjson", f"{with_sql('risk')} select risk_id as id, created_at, payload_id, agent_id, username, risk_score, signals, payload_id % 17 = 0 as is_test from risk")
def export_threats_ndjson(spark, sf_dir):
    """All risk events as a JSON object a line, read again."""
    test = F.get_json_object("signals", "$.source_kind") == "synthetic_test"
    rows = risk_events(spark, sf_dir).select(F.col("risk_id").alias("id"), "created_at", "payload_id", "agent_id", "username", "risk_score", "signals", test.alias("is_test"))
    return _round_trip(spark, rows, "ndjson")


# -- detectors, samples ----------------------------------------------------------------------------

_NAMES = {"file": "Isolation_Forest_v2", "http": "ZScore daily", "logon": "auth_velocity", "device": "advanced_auth", "process": "custom"}


@R.query("external_detectors", f"""{with_sql('obs')}, r as (select payload_id, collector, (k % 101)::double as score, case when k % 4 = 0 then 0.7 else (k % 10) / 10.0 end::double as c,
    k % 3 = 0 as anomaly from obs where event_id % 6 <> 0), a as (select payload_id,
    max(score) filter (collector in ('file', 'device')) as ms, max(score) filter (collector = 'http') as zs, max(score) filter (collector = 'logon') as aus,
    max(c) filter (collector in ('file', 'device')) as mc, max(c) filter (collector = 'http') as zc, max(c) filter (collector = 'logon') as ac, count(*) filter (anomaly) as n from r group by 1)
  select p.payload_id, coalesce(ms, 0) as ml_score, coalesce(zs, 0) as z_score, coalesce(aus, 0) as auth_score, greatest(coalesce(mc, 0.75), 0.75) as ml_confidence,
    coalesce(zc, 0) as z_confidence, coalesce(ac, 0) as auth_confidence, coalesce(n, 0) as anomalies from (select distinct payload_id from obs) p left join a using (payload_id)""")
def external_detectors(spark, sf_dir):
    name = F.element_at(F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv)), F.col("collector"))
    results = observations(spark, sf_dir).select(
        "payload_id", name.alias("detector_name"), (F.col("k") % 101).cast("double").alias("score"), F.when(F.col("k") % 4 != 0, (F.col("k") % 10) / 10.0).alias("confidence"),
        (F.col("k") % 3 == 0).alias("is_anomaly"), F.when(F.col("event_id") % 6 == 0, True).alias("is_shadow"),
    )
    return D.external(results, "payload_id")


@R.query("feature_extremes", f"""{with_sql('obs')}, l as (select agent_id, 'value' as feature, value - 20 as x, ts, event_id from obs where status = 'success'
    union all select agent_id, 'load', case when k % 5 <> 0 then k::double end, ts, event_id from obs where status = 'success'),
  s as (select agent_id, feature, greatest(x, 0) as x, row_number() over (partition by agent_id, feature order by ts, event_id) as nth from l where x is not null)
  select agent_id, feature, count(*) filter (nth <= {D.SAMPLES}) as samples, round(quantile_cont(x, 0.5) filter (nth <= {D.SAMPLES}), 9) as median, round(max(x), 9) as peak from s group by 1, 2""")
def feature_extremes(spark, sf_dir):
    obs = observations(spark, sf_dir).where("status = 'success'").select("agent_id", "ts", "event_id", (F.col("value") - 20).alias("value"), F.when(F.col("k") % 5 != 0, F.col("k").cast("double")).alias("load"))
    long = obs.unpivot(["agent_id", "ts", "event_id"], ["value", "load"], "feature", "x")
    out = D.extremes(long, ["agent_id", "feature"], [F.col("ts"), F.col("event_id")], "x")
    return out.select("agent_id", "feature", "samples", F.round("median", 9).alias("median"), F.round("peak", 9).alias("peak"))

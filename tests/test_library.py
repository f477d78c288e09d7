"""Cursors, guards and functions against values worked out by hand; two areas of queries against DuckDB."""

import math
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from riskloom.functions import content, identity
from riskloom.operators import explorer, fusion, ingest, rules, signals

SF = "/root/testdata/sf0.001"


def one(spark, row, **columns):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {v}" for k, v in columns.items()) or list(row))
    return df


def test_cursor_belongs_to_its_search():
    key = explorer.filter_key(agent="a", status=None)
    cursor = explorer.encode_cursor("hot", key, "2024-01-01", 5)
    assert explorer.decode_cursor(cursor, "hot", key) == ("2024-01-01", 5)
    for bad in (("cold", key), ("hot", "x")):
        with pytest.raises(ValueError):
            explorer.decode_cursor(cursor, *bad)
    with pytest.raises(ValueError):
        explorer.decode_cursor("%%%", "hot", key)
    with pytest.raises(ValueError):
        explorer.check_page(10, 5, cursor)
    with pytest.raises(ValueError):
        explorer.check_page(1001)


def test_collector_terms():
    assert explorer.collector_terms("usb-monitor") == ("usb", "device")
    assert explorer.collector_terms("My_Thing") == ("my_thing", "my-thing", "my_thing")


@pytest.mark.parametrize(("z", "score"), [(1.9, 0), (3.5, 47.5), (3.8, 52.0), (5.0, 70.0), (7.0, 95.0), (8.0, 100.0), (11.0, 100.0)])
def test_z_calibration(spark, z, score):
    got = spark.range(1).select(signals.calibrated(F.lit(z)).alias("s")).first().s
    assert math.isclose(got, score)


def test_three_domains_compound(spark):
    df = spark.range(1).withColumn("x", F.lit(1.0))
    got = signals.zscore(df, {n: F.lit(2.4) for n in ("daily_unique_pc_count", "file_access_count", "bytes_sent")}).first().z
    assert got.domains == 3 and math.isclose(got.score, max(16.0, math.sqrt(3 * 0.16) * 100 / 6 * 1.3), abs_tol=0.01)


def test_rules_on_one_snapshot(spark):
    df = spark.createDataFrame([(600.0, 150.0, 1.0, True)], "file_access_count double, daily_unique_filename_count double, cloud_storage_uploads double, threat_triggered boolean")
    got = rules.evaluate(df).first()
    assert {d.scenario for d in got.detections} == {"Bulk File Collection", "Cloud Upload Correlated with File Collection", "Honeytoken Access"}
    assert got.rule_score == 100.0 and got.rule_level == "CRITICAL"
    none = rules.evaluate(spark.createDataFrame([(None,)], "file_access_count double")).first()
    assert none.detections == [] and none.rule_score == 0.0


def test_domains_and_groups_in_order():
    assert rules.domain_of("Bulk USB File Transfer") == "FILE" and rules.domain_of("File-Sharing Site Visit") == "HTTP" and rules.domain_of("LSASS Credential Dumping Suspected") == "CREDENTIAL"
    assert rules.group_of("USB Device Activity") == "GROUP_USB Device Activity" and rules.group_of("Unapproved USB Device") == "DEVICE_USB_GROUP"
    assert signals.z_domain("daily_device_connect_count") == "device" and signals.z_domain("bytes_sent") == "network" and signals.z_domain("x") == "other"


def test_burst_that_the_host_is_used_to(spark):
    df = spark.createDataFrame([(4.0, 2.0, 0.1)], "unique_workstations_300s double, edr_auth_events_per_minute_window double, edr_failed_auth_ratio_window double")
    assert signals.auth_burst(df).first().auth.score == 75.0
    assert signals.auth_burst(df, {"unique_workstations_300s": F.lit(0.5)}).first().auth.score == 0.0


def test_uuid5_and_agents(spark):
    import uuid

    df = spark.createDataFrame([("7:col:file", None, " PC1 "), ("x", "{hostname}-a", "PC1"), ("y", "own", "PC1")], "name string, agent string, host string")
    got = df.select("name", identity.uuid5(F.col("name")).alias("u"), identity.effective_agent(F.col("agent"), F.col("host")).alias("a")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_OID, r.name)) for r in [type("R", (), r.asDict()) for r in got])
    assert [r.a for r in got] == ["AGENT-PC1", "PC1-a", "own"]


def test_scrubbing_of_nested_bodies(spark):
    body = '{"a":{"api_key":"zz","l":["Bearer abcdefghijklmnopq",3]},"cmd":"x --token=abc y","n":null}'
    got = spark.createDataFrame([(body,), (None,), ("no json",)], "b string").select(content.scrub_json("b").alias("b")).collect()
    assert got[0].b == '{"a":{"api_key":"[REDACTED]","l":["Bearer [REDACTED]",3]},"cmd":"x --token=[REDACTED] y","n":null}'
    assert got[1].b is None and got[2].b == "no json"


def test_flatten(spark):
    got = spark.createDataFrame([('{"event count":15,"etw.x":{"started-count":5,"_h":1},"l":[1,"a"],"o":[{"k":1},[]],"z":null}',)], "b string").select(content.flatten("b").alias("f")).first().f
    assert got == {"event_count": "15", "etw_x_started_count": "5", "l": "1;a", "o_0_k": "1", "o_1": "", "z": ""}


def test_required_interceptor_fails_closed(spark):
    chain = ingest.Interceptors()
    chain.register(1, "may")(lambda df: 1 / 0)
    assert chain.apply(spark.range(2)).count() == 2
    chain.register(2, "must", required=True)(lambda df: 1 / 0)
    with pytest.raises(RuntimeError):
        chain.apply(spark.range(2))


def test_claim_gives_at_least_one(spark):
    rows = spark.createDataFrame([(1, 900), (2, 50), (3, 60)], "payload_id long, bytes long")
    assert [r.payload_id for r in explorer.claim(rows, 10, 100).collect()] == [1]
    assert [r.payload_id for r in explorer.claim(rows, 2, 1000).collect()] == [1, 2]


def test_prior_of_another_day_is_none(spark):
    p = spark.createDataFrame([("a", "d1", 25, 0.9, 0.1, 0.1, 0.1, 8), ("b", "d0", 25, 0.9, 0.1, 0.1, 0.1, 8), ("c", "d1", 21, 0.9, 0.1, 0.1, 0.1, 8)], "agent_id string, as_of string, history_days int, threat_probability double, fused_risk double, drift_error double, pair_threat double, classes int")
    got = {r.agent_id: r.ml for r in fusion.prior_detector(p, F.lit("d1")).collect()}
    assert got["a"].score == 90.0 and got["a"].is_anomaly and got["b"] is None and got["c"] is None


@pytest.mark.parametrize("name", ["hist_2h", "page_seek", "latest_state", "rollup_merge", "dedup_first_wins", "event_uuid5", "pc_presence", "auth_burst", "zscore"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = sorted(c[0] for c in found.description)
    shape = lambda rows: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    wanted = con.execute(f"select {', '.join(names)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert shape(wanted) == shape(tuple(r) for r in df.select(*names).collect())


def test_event_time_of_the_explorer_is_pushed_down(spark):
    obs = spark.read.parquet(f"{SF}/events.parquet")
    plan = obs.where(explorer.within(F.col("ts"), datetime(2024, 1, 5), datetime(2024, 1, 6)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan

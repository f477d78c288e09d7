"""Explorer operators over repeated rows, and queries over whole tables."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from riskloom.operators import explorer


def test_repeats_in_a_store_do_not_shorten_the_page(spark):
    rows = spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    again = rows.where("event_id = 299").crossJoin(spark.range(201).drop("id").withColumn("x", F.lit(1))).select("event_id", "ts")
    stores = [rows.unionByName(again), rows.where("event_id % 2 = 1").unionByName(again)]
    assert [r.event_id for r in explorer.merged(stores, 200).collect()] == list(range(299, 99, -1))


def test_an_id_counts_by_its_newest_row(spark):
    old = spark.createDataFrame([(1, 1), (2, 5)], "event_id long, ts long")
    new = spark.createDataFrame([(1, 9), (3, None)], "event_id long, ts long")
    assert [(r.event_id, r.ts) for r in explorer.merged([old, new], 3).collect()] == [(1, 9), (2, 5), (3, None)]


@pytest.mark.parametrize("name", ["event_detail", "event_detail_counts", "rollup_minute_all", "latest_state_fallback"])
def test_query_against_its_sql(spark, name):
    con, sql = duckdb.connect(), __spark_entry__.oracle_sql()
    con.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"select {', '.join(df.columns)} from ({sql[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))


def test_whole_table_leaves_no_event_out(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    every = __spark_entry__.queries()
    assert every["rollup_minute_all"](spark, "/root/testdata/sf0.001").agg(F.sum("events")).first()[0] == events
    assert every["event_detail_counts"](spark, "/root/testdata/sf0.001").count() == events


def test_an_id_that_fills_a_store_hides_no_other(spark):
    rows = [(7, 1000 - i) for i in range(500)] + [(i, 100 - i) for i in range(5)]
    store = spark.createDataFrame(rows, "event_id long, ts long")
    assert [r.event_id for r in explorer.merged([store, store.where("event_id < 3")], 4).collect()] == [7, 0, 1, 2]


def test_detail_of_no_event_and_without_risk(spark):
    events = spark.createDataFrame([(1, "A", 5.0)], "event_id long, agent_id string, x double").selectExpr("event_id", "agent_id", "timestamp_ntz'2024-01-05 00:00:00' as ts")
    risk = spark.createDataFrame([("A", 9, 1.0), ("B", 8, 2.0)], "agent_id string, risk_id long, risk_score double").selectExpr("*", "timestamp_ntz'2024-01-07 00:00:01' as created_at")
    assert explorer.event_detail(events, risk, 2).collect() == []
    assert [r.risk_id for r in explorer.event_detail(events, risk, 1).collect()] == [None]
    assert [(r.risks, r.most, r.latest) for r in explorer.risk_around(events, risk).collect()] == [(0, None, None)]
    assert [(r.risks, r.most, r.latest) for r in explorer.risk_around(events, risk, 3).collect()] == [(1, 1.0, 9)]


def test_cursors_that_are_none():
    import base64
    import json

    key, one = explorer.filter_key(a=1), "00000000-0000-5000-8000-000000000001"
    made = lambda *v: base64.urlsafe_b64encode(json.dumps(v).encode()).decode()
    assert explorer.decode_cursor(made(1, "clickhouse", key, "2024-01-01T00:00:00Z", one), "clickhouse", key) == ("2024-01-01T00:00:00Z", one)
    assert explorer.decode_cursor(made(1, "postgres", key, None, "7"), "postgres", key) == (None, 7)
    bad = [(2, "postgres", key, None, "7"), (1, "postgres", key, "yesterday", "7"), (1, "postgres", key, None, "-1"), (1, "postgres", key, None, str(1 << 63)), (1, "postgres", key, 5, "7"), (1, "postgres", key, None, one), (1, "clickhouse", key, None, "7x"), (1, "postgres", key, None)]
    for v in bad:
        with pytest.raises(ValueError, match="begin with the first page"):
            explorer.decode_cursor(made(*v), v[1], key)
    for text in ("%%%", made(1, "postgres", key, None, "7") + "!", "A" * 1025, "", made(1, "postgres", "x" * 2000, None, "7")):
        with pytest.raises(ValueError, match="begin with the first page"):
            explorer.decode_cursor(text, "postgres", key)


def test_risk_around_by_brute_force(spark):
    rng = random.Random(4)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(200), seconds=rng.choice([0, 0, 1, 1799, 3599]))
    events = [(i, rng.choice(["a", "b", "c", None]), at() if rng.random() < 0.97 else None) for i in range(300)]
    risk = [(rng.choice(["a", "b", None]), 1000 + i, at(), float(rng.randrange(50))) for i in range(200)]
    got = explorer.risk_around(spark.createDataFrame(events, "event_id long, agent_id string, ts timestamp_ntz"), spark.createDataFrame(risk, "agent_id string, risk_id long, created_at timestamp_ntz, risk_score double"))
    want = []
    for i, agent, ts in events:
        near = [r for r in risk if agent is not None and ts is not None and r[0] == agent and abs(r[2] - ts) <= timedelta(days=2)]
        want.append((i, agent, ts, len(near), max((r[3] for r in near), default=None), max(((r[2], r[1]) for r in near), default=(None, None))[1]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    # a span's both ends count, and no event looks at the rows of a span one by one
    assert "INTERVAL '2" not in got._jdf.queryExecution().executedPlan().toString()

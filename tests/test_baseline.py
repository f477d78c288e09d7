"""Baselines against brute force, hand-worked values and DuckDB."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import baseline
from riskloom.plans import baseline as plans

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_baseline_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    wanted = con.execute(f"select {', '.join(df.columns)} from ({plans.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(wanted) > 0
    for g, w in zip(sorted(got, key=repr), sorted(wanted, key=repr)):
        assert all(a == pytest.approx(b, abs=2e-6) if isinstance(a, float) else a == b for a, b in zip(g, w)), (g, w)


def _greedy(times):
    out, last = [], None
    for at, key in sorted(times):
        if last is None or (at - last).total_seconds() >= 3600:
            out.append(key)
            last = at
    return out


def test_throttle_is_the_greedy_choice(spark):
    start = datetime(2024, 1, 1)
    minutes = [0, 0, 59, 60, 61, 90, 119, 120, 121, 400, 459, 460, 461, 520, 521, 1000]
    rows = [(u, i + 100 * u, start + timedelta(minutes=m + u * 7)) for u in range(3) for i, m in enumerate(minutes)]
    got = baseline.throttle(spark.createDataFrame(rows, "u int, payload_id long, ts timestamp"), ["u"])
    wanted = {k for u in range(3) for k in _greedy([(t, p) for v, p, t in rows if v == u])}
    assert {r.payload_id for r in got.collect()} == wanted


def test_average_of_days_leaves_the_open_one(spark):
    rows = [("a", i, datetime(2024, 1, 1 + i, 12), v) for i, v in enumerate([10.0, 40.0, None, 99.0])]
    df = spark.createDataFrame(rows, "username string, payload_id long, ts timestamp_ntz, file_access_count double")
    (got,) = baseline.moving_average(df, "username", ["file_access_count"]).collect()
    rate = 2 / 15
    assert got["samples"] == 2
    assert got["mean"] == pytest.approx(10 * (1 - rate) + 40 * rate)
    assert got["std"] == pytest.approx(1.0 * (1 - rate) + 30 * rate)
    assert baseline.moving_average(df.limit(0), "username", ["file_access_count"]).count() == 0


def test_host_values_are_bounded_once_mature(spark):
    rows = [("h", i, datetime(2024, 1, 1 + i, 12), v) for i, v in enumerate([2.0, 2.0, 2.0, -4.0, 1000.0, 5.0])]
    df = spark.createDataFrame(rows, "agent_id string, payload_id long, ts timestamp_ntz, off_hours_auth_count double")
    (got,) = baseline.bounded_average(df, "agent_id", ["off_hours_auth_count"]).collect()
    assert got["samples"] == 5 and got["mean"] < 4


def test_roles_and_floors(spark):
    rows = [("SysOp", None), ("bob", " Team Lead "), ("bob", ""), ("root7", "  ")]
    df = spark.createDataFrame(rows, "u string, r string").select(baseline.infer_role(F.col("u"), F.col("r")))
    assert [r[0] for r in df.collect()] == ["administrator", "team_lead", "standard_user", "administrator"]
    floors = spark.range(1).select(baseline.std_floor(F.lit("Fail_RATE"), F.lit(-2.0), 1.0), baseline.std_floor(F.lit("n"), F.lit(3.0), 1.0), baseline.confidence(F.lit(0)), baseline.confidence(F.lit(7)))
    assert list(floors.first()) == pytest.approx([0.2, 1.0, 0.1, 0.5])

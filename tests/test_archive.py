"""Archive and rollup: broken off after every step, run again, read without loss or overlap."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.explorer import minute_rollup
from riskloom.streaming import archive as A
from riskloom.streaming import rollup as U

SCHEMA = "event_id long, agent_id string, collector string, status string, ts timestamp_ntz, body string"
STEPS = ["building", "chunks", "read back", "totals", "published", "dropped"]


@pytest.fixture
def live(spark, tmp_path):
    rows = spark.range(500).selectExpr("id as event_id", "concat('A', id % 3) as agent_id", "case when id % 2 = 0 then 'file' else 'http' end as collector", "'success' as status", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id % 3, 0, id % 7) as ts", "case when id % 5 > 0 then repeat('é\"', cast(id % 50 as int)) end as body")
    rows.withColumn("received_day", F.to_date("ts")).write.partitionBy("received_day").parquet(f"{tmp_path}/live")
    return f"{tmp_path}/live", f"{tmp_path}/cold", rows.collect()


def everything(spark, live, root):
    return sorted(A.rows(spark, live, root, SCHEMA).collect(), key=lambda r: r.event_id)


@pytest.mark.parametrize("step", STEPS)
def test_broken_off_after_each_step(spark, live, step, monkeypatch):
    monkeypatch.setattr(A, "ROWS", 40)
    where, root, rows = live
    rows = sorted(rows, key=lambda r: r.event_id)

    def stop(ended):
        if ended == step:
            raise KeyboardInterrupt

    A.archive_day(spark, where, root, "2024-01-01")
    with pytest.raises(KeyboardInterrupt):
        A.archive_day(spark, where, root, "2024-01-02", after=stop)
    assert everything(spark, where, root) == rows
    assert A.archive_day(spark, where, root, "2024-01-02") == (step != "dropped")
    assert everything(spark, where, root) == rows and not A.archive_day(spark, where, root, "2024-01-02")
    ledger = A.verified(spark, root)
    assert set(ledger) == {"2024-01-01", "2024-01-02"} and all(v["chunks"] >= 4 for v in ledger.values())
    assert {(r.collector, r.n) for r in A.totals(spark, where, root).collect()} == {("file", 250), ("http", 250)}


def test_chunks_expiry_and_damage(spark, live, monkeypatch):
    where, root, rows = live
    monkeypatch.setattr(A, "BYTES", 2000)
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        A.archive_day(spark, where, root, day)
    runs = A.verified(spark, root)
    found = spark.read.parquet(f"{runs['2024-01-01']['run']}/chunks")
    assert found.agg(F.max("size")).first()[0] <= 2000 and A.chain(spark, runs["2024-01-01"]["run"])[0] == runs["2024-01-01"]["checksum"]
    assert A.expire(spark, root, "2024-01-02") == ["2024-01-01"] and A.expire(spark, root, "2024-01-02") == []
    assert [r.event_id for r in everything(spark, where, root)] == [r.event_id for r in sorted(rows, key=lambda r: r.event_id) if r.event_id % 3]
    with pytest.raises(ValueError, match="no rows and no archive"):
        A.archive_day(spark, where, root, "2024-01-01")
    broken = spark.read.parquet(f"{runs['2024-01-02']['run']}/chunks").withColumn("checksum", F.lit("0" * 64))
    with pytest.raises(Exception, match="differs from its digest"):
        A.opened(broken, SCHEMA).count()
    monkeypatch.setattr(A, "BYTES", 20)
    with pytest.raises(Exception, match="larger than a chunk"):
        A.chunks(spark.createDataFrame(rows[:1], SCHEMA), "ts", "event_id").count()


def test_an_empty_archive(spark, tmp_path):
    assert everything(spark, f"{tmp_path}/none", f"{tmp_path}/cold") == [] and A.totals(spark, f"{tmp_path}/none", f"{tmp_path}/cold").count() == 0


def source(spark, n, step=37):
    return spark.range(n).selectExpr("id as event_id", "concat('A', id % 3) as agent_id", f"timestamp_ntz'2024-01-01 00:00:30' + make_dt_interval(0, 0, id * {step} % 700) as ts")


def one_pass(df):
    return sorted(map(tuple, minute_rollup(df, ["agent_id"]).collect()))


def test_rollup_twice_and_with_late_rows(spark, tmp_path):
    root, df = str(tmp_path), source(spark, 300)
    assert U.roll_up(df, root, ["agent_id"], minutes=60, at_once=5) == 12
    assert U.roll_up(df, root, ["agent_id"], minutes=60) == 0
    assert sorted(map(tuple, U.minutes(spark, root).select("minute", "agent_id", "event_id").collect())) == one_pass(df)
    more = df.unionByName(df.where("event_id < 50")).unionByName(spark.sql("select 9000L as event_id, 'A1' as agent_id, timestamp_ntz'2024-01-01 03:10:00' as ts"))
    assert U.roll_up(more, root, ["agent_id"], minutes=60) == 1
    assert sorted(map(tuple, U.minutes(spark, root).select("minute", "agent_id", "event_id").collect())) == one_pass(more)


def test_rollup_broken_off(spark, tmp_path, monkeypatch):
    root, df, real = str(tmp_path), source(spark, 200), U.finished_number
    calls = []

    def fail(*a):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("killed")
        return real(*a)

    monkeypatch.setattr(U, "finished_number", fail)
    with pytest.raises(OSError, match="killed"):
        U.roll_up(df, root, ["agent_id"], minutes=60, at_once=4)
    assert U.roll_up(df, root, ["agent_id"], minutes=60, at_once=4) == 8
    assert sorted(map(tuple, U.minutes(spark, root).select("minute", "agent_id", "event_id").collect())) == one_pass(df)
    monkeypatch.setattr(U, "minute_rollup", lambda *a: minute_rollup(*a).where("event_id % 2 = 0"))
    with pytest.raises(ValueError, match="differs from its source"):
        U.roll_up(source(spark, 201), root, ["agent_id"], minutes=60)

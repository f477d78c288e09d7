"""Host-days are made once: what reads them reads what was written."""

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.operators import hostdays as H
from riskloom.plans import daily
from riskloom.sources.views import activity, observations, seen_days

SF = "/root/testdata/sf0.001"


def test_days_are_made_once_and_read_from_the_shared_folder(spark):
    days = daily.measured(daily.host_days(spark, SF))
    assert days.count() and not [f for f in days.inputFiles() if "events" in f]


def test_replays_count_once_and_a_day_has_a_heartbeat_of_each_sensor(spark):
    rows = activity(spark, SF)
    beats = rows.where(F.col("kind").startswith("heartbeat:"))
    assert beats.groupBy("agent_id", F.to_date("ts"), "kind").count().where("count > 1").count() == 0
    one, twice = (H.produce(r).drop("missing_sensors") for r in (rows, rows.unionByName(rows)))
    assert one.count() and one.exceptAll(twice).count() == twice.exceptAll(one).count() == 0


def test_records_and_heartbeats_are_made_without_sorting_them(spark):
    assert "SortAggregate" not in activity(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_only_records_that_repeat_are_dealt_out_anew(spark, tmp_path):
    rows = spark.createDataFrame([(e, k, f"{e}{k}") for e in (1, 2, None) for k in ("file", "http")], "event_id long, kind string, item string")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert H.told_apart(rows, f"{tmp_path}/same").inputFiles() == rows.inputFiles()
    more = rows.unionByName(rows.where("event_id = 2 or event_id is null")).unionByName(rows.where("event_id = 2 and kind = 'file'"))
    got = H.told_apart(more, f"{tmp_path}/once")
    assert got.count() == 6 and got.exceptAll(rows).count() == 0


def test_events_are_counted_in_place_of_their_records(spark, tmp_path):
    rows = spark.createDataFrame([(e, k, f"{e}{k}") for e in (1, 2, None) for k in ("file", "http")], "event_id long, kind string, item string")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    ids = spark.createDataFrame([(1,), (2,), (None,)], "event_id long")
    assert H.told_apart(rows, f"{tmp_path}/same", ids).inputFiles() == rows.inputFiles()
    again = ids.where("event_id = 2 or event_id is null")
    got = H.told_apart(rows.unionByName(rows.join(again, rows.event_id.eqNullSafe(again.event_id), "left_semi")), f"{tmp_path}/once", ids.unionByName(again))
    assert got.count() == 6 and got.exceptAll(rows).count() == 0


def test_replayed_events_count_once_by_their_numbers_too(spark):
    rows, ids = activity(spark, SF), observations(spark, SF)
    one, twice = (H.produce(r, i).drop("missing_sensors") for r, i in ((rows, None), (rows.unionByName(rows), ids.unionByName(ids))))
    assert one.count() and one.exceptAll(twice).count() == twice.exceptAll(one).count() == 0


def test_days_that_were_seen_already_are_not_looked_for_again(spark, tmp_path):
    seen_days(spark, SF).write.parquet(f"{tmp_path}/seen")
    got, want = activity(spark, SF, spark.read.parquet(f"{tmp_path}/seen")), activity(spark, SF)
    assert "Aggregate" in want._jdf.queryExecution().executedPlan().toString() and "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_counters_rise_in_one_pass(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("a", at(1), "x", 1, 5.0), ("a", at(2), "x", 2, 9.0), ("a", at(3), "x", 3, 4.0), ("a", at(2), "y", 2, 7.0), ("b", at(1), "x", 4, 1.0), ("b", at(1), "z", 5, 3.0)]
    got = H.rises(spark.createDataFrame(rows, "agent_id string, ts timestamp_ntz, kind string, event_id long, amount double"), "x", "y")
    assert {(r.agent_id, r.x, r.y) for r in got.collect()} == {("a", 13.0, 7.0), ("b", 1.0, None)}
    assert got._jdf.queryExecution().analyzed().toString().count("Window ") == 1

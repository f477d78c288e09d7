"""Host-days, keystrokes, streams and archives against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["host_day_admission", "host_day_calendar", "evidence_dates", "keystroke_streams", "stream_ingest", "archive_days"])
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


def test_triage_audits_every_word_and_refuses_others(spark):
    from riskloom.operators import daily as D

    queue = spark.createDataFrame([(1, "A", "new", 5), (1, "B", "needs_investigation", 6)], "as_of int, agent_id string, analyst_status string, rank int")
    said = [(1, "A", "needs_investigation", "look", "ann", 1), (1, "A", "confirmed_incident", None, "bob", 2), (2, "A", "benign_context", "", "ann", 1), (1, "C", "benign_context", "", "ann", 1)]
    schema = "as_of int, agent_id string, status string, note string, actor string, nth int"
    now, audit = D.triage(queue, spark.createDataFrame(said, schema), "2024-01-30")
    assert sorted((r.agent_id, r.analyst_status, r.analyst_note, r.reviewed_by, r.rank) for r in now.collect()) == [("A", "confirmed_incident", None, "bob", 5), ("B", "needs_investigation", None, None, 6)]
    assert sorted((r.agent_id, r.previous_status, r.new_status) for r in audit.collect()) == [("A", "needs_investigation", "confirmed_incident"), ("A", "new", "needs_investigation")]
    with pytest.raises(Exception, match="no analyst status"):
        D.triage(queue, spark.createDataFrame([(1, "A", "maybe", "", "ann", 1)], schema), "2024-01-30")[0].collect()

"""Columns that the data has, and steps of one's own over rows."""

import json

import pytest

from riskloom.operators import ingest as I


def test_every_leaf_of_every_body_is_a_column(spark):
    bodies = ['{"a":1,"b":{"c":[1,2],"d-e":"x"}}', '{"A":null,"event_id":5}', "{}", None, '{"list":[{"k":1},{"k":2}],"_hidden":3}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "event_id long, body string")
    out = I.dataset(rows, ["event_id"])
    assert out.columns[0] == "event_id" and set(out.columns[1:]) >= {"a", "A", "b_c", "b_d_e", "feature_event_id"} and not any("hidden" in c for c in out.columns)
    first = out.where("event_id = 0").toPandas().iloc[0]
    assert (first["b_c"], first["b_d_e"], first["feature_event_id"]) == ("1;2", "x", "")
    with pytest.raises(ValueError, match="more than 2"):
        I.dataset(rows, ["event_id"], most=2)
    assert I.dataset(rows.where("false"), ["event_id"]).columns == ["event_id"]


def test_matrix_types_and_missing_values(spark):
    rows = spark.createDataFrame([(1, {"n": "3", "t": "x", "m": "2"}), (2, {"n": "0.5", "m": "zwei"}), (3, {}), (4, None), (5, {"n": None})], "id long, p map<string,string>")
    got = {r.id: r for r in I.matrix(rows, ["id"], "p").collect()}
    assert [got[i].n for i in range(1, 6)] == [3.0, 0.5, 0.0, 0.0, 0.0]
    assert [got[i].t for i in (1, 2, 4)] == ["x", "0.0", "0.0"] and [got[i].m for i in (1, 2, 3)] == ["2.0", "zwei", "0.0"]


def test_a_row_that_raises_and_a_required_step(spark):
    rows = spark.createDataFrame([(i, json.dumps({"x": i})) for i in range(6)] + [(6, "not json"), (7, None)], "id long, payload string")
    chain = I.Interceptors()

    @chain.register_rows(20, "divide")
    def divide(body):
        return body | {"y": 6 // (body["x"] - 3)}

    @chain.register_rows(10, "even")
    def even(body):
        return None if body["x"] == 4 else body

    good, dead = chain.split(chain.examine(rows))
    assert {r.id: r.payload and json.loads(r.payload) for r in good.collect()} == {i: {"x": i, "y": 6 // (i - 3)} for i in (0, 1, 2, 5)} | {7: None}
    assert {(r.id, r.failed_in, r.failure.split(":")[0]) for r in dead.collect()} == {(3, "divide", "ZeroDivisionError"), (6, "even", "JSONDecodeError")}
    assert [r.payload for r in dead.where("id = 3").collect()] == ['{"x": 3}']
    chain.register_rows(20, "divide", required=True)(divide)
    with pytest.raises(Exception, match="required interceptor divide failed"):
        chain.examine(rows).collect()
    assert chain.examine(rows.where("id < 3")).count() == 3
    assert I.Interceptors().examine(rows).where("failed_in is null").count() == 8


def test_parameters_of_two_levels_first_wins(spark):
    snapshot = {"collectors": [
        {"status": "success", "payload": {"b": {"x": 1, "deep": {"y": "t", "z": {"k": [1, 2]}}}, "x": 5, "n": None, "l": [1, "a"]}},
        {"status": "failed", "payload": {"q": 1}}, {"status": "success", "payload": "text"}, 7, {"status": "success", "payload": {"x": 9, "w": True, "n": 2.5}},
    ]}
    rows = [json.dumps(snapshot), json.dumps({"agent_id": "A", "k": 3, "collectors": []}), "[]", "nope", None]
    got = [r.p for r in spark.createDataFrame(list(enumerate(rows)), "i int, b string").orderBy("i").select(I.parameters("b").alias("p")).collect()]
    assert got == [{"x": "1", "y": "t", "z": '{"k":[1,2]}', "l": '[1,"a"]', "w": "true", "n": "2.5"}, {"k": "3"}, None, None, None]


def test_numbers_clock_times_and_derived_counts(spark):
    from pyspark.sql import functions as F

    texts = ["3.5", " 02:30 ", "25", "x", None, "NaN", "1:5"]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(I.numeric(F.col("t")).alias("n")).collect()]
    assert got == [3.5, 2.5, 25.0, 0.0, 0.0, 0.0, 0.0]
    maps = [{"file_open_count": "2", "daily_file_write_count": "3", "integrity_events_0_op": "Delete"}, {"file_access_count": "1", "file_open_count": "2"}, {}, {"integrity_events_0_op": ""}]
    rows = I.derived(spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>"), "m").orderBy("i").collect()
    assert [r.m.get("file_access_count") for r in rows] == ["6.0", "1", None, None] and rows[0].m["file_delete_count"] == "1.0"


def test_last_source_is_asked_only_if_the_others_have_nobody(spark):
    from riskloom.operators import fleet

    one = spark.createDataFrame([("A", "h", 1)], "agent_id string, hostname string, seen_at int")
    other = spark.createDataFrame([("B", "g", 2)], one.schema)
    assert [r.agent_id for r in fleet.discover([one], other).collect()] == ["A"]
    assert [r.agent_id for r in fleet.discover([one.where("false")], other).collect()] == ["B"]


def test_a_cursor_without_a_time(spark):
    from riskloom.operators import explorer

    rows = spark.sql("select * from values (1, timestamp_ntz'2024-01-02 00:00:00'), (2, null), (3, null), (9, timestamp_ntz'2024-01-01 00:00:00') as t(id, ts)")
    assert sorted(r.id for r in rows.where(explorer.after(["ts", "id"], [None, 3])).collect()) == [1, 2]

"""The stream of snapshots: nothing vanishes, whatever is broken, late, repeated or broken off."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions.content import canonical_json
from riskloom.operators.ingest import body_violations
from riskloom.streaming import ingest as S


def line(n, day="2024-01-10", host="h", **more):
    c = {"collector": "file", "collected_at": f"{day}T00:00:00Z", "hostname": host, "status": "success", "payload": {"a": 1}}
    return {"protocol_version": "2.0", "schema": "insiedr.agent.telemetry.v1", "payload_id": f"p{n}", "agent_id": "A", "hostname": host, "collected_at": f"{day}T00:00:00Z", "collectors": [c], "summary": {"collector_count": 1, "success_count": 1, "failed_count": 0}} | more


@pytest.fixture
def stream(spark, tmp_path):
    """Writes files, one micro-batch each, and tells what lies where."""
    top = str(tmp_path)

    def run(*files, clock=None):
        for i, lines in enumerate(files):
            number = len(list((tmp_path / "in").glob("*.txt"))) if (tmp_path / "in").exists() else 0
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{number + 1:03}.txt").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
            S.ingest(S.read(spark, f"{top}/in"), f"{top}/out", f"{top}/state", clock, availableNow=True).awaitTermination()
        accepted = sorted(r.payload_id for r in S.table(spark, f"{top}/out", "accepted").collect())
        dead = sorted((r.reason, r.attempts) for r in S.table(spark, f"{top}/out", "dead").collect())
        return accepted, dead

    run.top = top
    return run


def test_a_broken_line_hides_nothing(stream):
    accepted, dead = stream(["not json", line(1)], [line(2, "2024-01-09")], [line(3, "2024-01-11"), line(4)])
    assert accepted == ["p1", "p2", "p3", "p4"] and dead == [("unreadable", 1)]


def test_late_repeated_conflicting_and_future_lines(stream, spark):
    clock = F.lit("2024-02-01").cast("timestamp")
    turned = dict(reversed(list(line(2).items())))  # the same content with its keys in another order
    accepted, dead = stream([line(1), line(2), line(2), line(2, "2024-01-11", host="other")], [turned, line(2, host="third"), line(3, "2024-01-12"), line(9, "2024-03-01")], [line(4, "2024-01-10"), line(5, "2024-01-11")], clock=clock)
    assert accepted == ["p1", "p2", "p3", "p5"]
    assert [r for r, _ in dead] == ["conflict", "conflict", "future", "late"]
    manifest = S.table(spark, f"{stream.top}/out", "manifest").agg(F.sum("accepted"), F.sum("repeats"), F.sum("dead")).first()
    assert tuple(manifest) == (4, 2, 4)


def test_dead_letters_come_back(stream, spark):
    stream([line(1, "2024-01-20"), "broken"], [line(2, "2024-01-02"), line(1, "2024-01-20", host="x")])
    top = stream.top
    for _ in range(4):  # a late one is released at once, what stays broken goes round until its attempts are used up
        S.replay(spark, f"{top}/out", f"{top}/in", f"{top}/replay", ["late", "unreadable"], availableNow=True).awaitTermination()
        S.ingest(S.read(spark, f"{top}/in"), f"{top}/out", f"{top}/state", availableNow=True).awaitTermination()
    assert sorted(r.payload_id for r in S.table(spark, f"{top}/out", "accepted").collect()) == ["p1", "p2"]
    dead = sorted((r.reason, r.attempts) for r in S.table(spark, f"{top}/out", "dead").collect())
    assert dead == [("conflict", 1), ("late", 1), ("unreadable", 1), ("unreadable", 2), ("unreadable", 3)]


@pytest.mark.parametrize("after", ["dead", "accepted", "registry"])
def test_a_batch_broken_off_between_writes(spark, tmp_path, monkeypatch, after):
    root = str(tmp_path / "out")
    first = spark.createDataFrame([(json.dumps(x),) for x in (line(1), line(1), line(2))] + [("broken",)], "value string")
    second = spark.createDataFrame([(json.dumps(x),) for x in (line(2), line(3), line(1, host="y"))], "value string")
    S.take(first, 0, root)
    real = type(spark.range(1).write).parquet
    wrote = []

    def parquet(self, path, *a, **k):
        real(self, path, *a, **k)
        wrote.append(path)
        if f"/{after}/batch=1" in path and sum(f"/{after}/batch=1" in w for w in wrote) == 1:
            raise OSError("killed")

    monkeypatch.setattr(type(spark.range(1).write), "parquet", parquet)
    with pytest.raises(OSError, match="killed"):
        S.take(second, 1, root)
    assert sorted(r.payload_id for r in S.table(spark, root, "accepted").collect()) == ["p1", "p2"]
    S.take(second, 1, root)
    assert sorted(r.payload_id for r in S.table(spark, root, "accepted").collect()) == ["p1", "p2", "p3"]
    assert sorted(r.reason for r in S.table(spark, root, "dead").collect()) == ["conflict", "unreadable"]


def test_rules_over_bodies(spark):
    one = line(1)["collectors"][0]
    cases = {
        "": line(1), "unreadable": "[1]", "protocol_version": line(1, protocol_version=2), "schema": line(1, schema=""), "payload_id": line(1, payload_id=7), "hostname": line(1, hostname=None),
        "unsupported_protocol": line(1, protocol_version="1.0"), "unsupported_schema": line(1, schema="x"), "summary,collector_count,success_count,failed_count": line(1, summary=[]),
        "success_count": line(1, summary={"collector_count": 1.0, "success_count": 2, "failed_count": 0}), "collectors,collector_count,success_count": line(1, collectors={}),
        "collector_object,collector_field,collector_count": line(1, collectors=[one, 3]), "collector_field": line(1, collectors=[one | {"hostname": ""}]), "status,success_count": line(1, collectors=[one | {"status": "odd"}]),
        "payload": line(1, collectors=[{k: v for k, v in one.items() if k != "payload"}]), "error": line(1, collectors=[one | {"status": "failed", "error": "x"}], summary={"collector_count": 1, "success_count": 0, "failed_count": 1}),
        "collector_limit": line(1, collectors=[one] * 101, summary={"collector_count": 101, "success_count": 101, "failed_count": 0}),
    }
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in cases.items()] + [("unreadable", None), ("unreadable", "")]
    got = spark.createDataFrame(rows, "want string, body string").select("want", F.array_join(body_violations(F.col("body")), ",").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    null_payload = line(1, collectors=[one | {"payload": None}])
    assert spark.createDataFrame([(json.dumps(null_payload),)], "body string").select(F.size(body_violations(F.col("body")))).first()[0] == 0


def test_canonical_json_is_pythons(spark):
    bodies = ['{"b":1.10,"a":[1e5,1E22,-0.0,12345678901234567890123]}', '{"é":"\\u00e9\\u001f/\\u2028","\\ud83d\\ude00":1,"\\uffff":2}', '{"a":1,"a":{"z":null,"y":true}}', "3", '"x"', "nope", None, "[" * 5000]
    got = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i").select(canonical_json("b")).collect()]
    want = [json.dumps(json.loads(b), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for b in bodies[:5]]
    assert got == [*want, None, None, None]


def test_files_that_lie_there_together_are_not_late_for_one_another(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, *lines: (tmp_path / "in" / name).write_text("".join(json.dumps(x) + "\n" for x in lines))
    for n, day in enumerate(("2024-01-20", "2024-01-02", "2024-01-11")):
        put(f"{n}.txt", line(n, day), line(9, "2024-01-10", host="ab"[n > 0]))
    drain = lambda: S.drain(S.read(spark, str(tmp_path / "in"), size=1), str(tmp_path / "out"), str(tmp_path / "state"))
    drain()
    assert S.table(spark, str(tmp_path / "out"), "manifest").count() == 3
    read = lambda name, c: sorted(r[0] for r in S.table(spark, str(tmp_path / "out"), name).select(c).collect())
    assert read("accepted", "payload_id") == ["p0", "p1", "p2", "p9"] and len(read("dead", "reason")) in (1, 2) and set(read("dead", "reason")) == {"conflict"}
    put("3.txt", line(4, "2024-01-12"), line(5, "2024-01-20"))
    drain()
    assert read("accepted", "payload_id") == ["p0", "p1", "p2", "p5", "p9"] and read("dead", "reason")[-1] == "late"
    assert not (tmp_path / "out" / "draining").exists()


def test_a_body_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "body string").select(body_violations(F.col("body")))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json(body#") == 1

"""Scores against baselines left by earlier snapshots: the fixed point equals a walk, in one batch and in several."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import learning as L

USERS, HOSTS = ("file_access_count", "bytes_rate", "odd"), ("auth_rate_300s", "odd")


def score(df):
    """A score that calm and alarming rows both have: from the user's greatest deviation."""
    most = F.greatest(F.lit(0.0), *(F.coalesce(F.col(f"z_{f}"), F.lit(0.0)) for f in USERS))
    host = F.greatest(F.lit(0.0), *(F.coalesce(F.col(f"host_z_{f}"), F.lit(0.0)) for f in HOSTS))
    return df.withColumns({"risk_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), 9 * most + host)), "burst": host >= 4, "sure": F.coalesce(F.col("flag"), F.lit(False))})


def walk(rows, states=None):
    """One snapshot after the other."""
    states, out = dict(states or {}), {}
    held = lambda kind, e: L.Baseline(kind, states.get((kind, e)))

    def z(f, v, tiers, prior, least):
        for b in tiers:
            if b.samples.get(f, 0) >= 5:
                return (v - b.mean[f]) / max(b.std[f], L.floor_of(f, b.mean[f], least))
        return (v - prior[0]) / max(prior[1], L.floor_of(f, prior[0], least)) if prior else 0.0

    for r in sorted(rows, key=lambda r: (r["arrived"], r["payload_id"])):
        user, role, host = held("user", r["username"]), held("role", r["role_name"]), held("host", r["agent_id"])
        own = {f: r[f] for f in USERS if r[f] is not None and r[f] == r[f]}
        its = {f: r[f] for f in HOSTS if r[f] is not None and r[f] == r[f]}
        most = max([0.0, *(z(f, v, (user, role), L.USER_PRIORS.get(f), 1.0) for f, v in own.items())]) if r["username"] else 0.0
        far = max([0.0, *(z(f, v, (host,), L.HOST_PRIORS.get(f), 0.5) for f, v in its.items())]) if r["agent_id"] else 0.0
        risk = min(100.0, max(0.0, 9 * most + far))
        out[r["payload_id"]] = risk
        at = int((r["ts"] - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        if risk < 40 and r["username"] and own:
            for b, e in ((user, ("user", r["username"])), (role, ("role", r["role_name"]))):
                b.take(at, own, r["username"].lower())
                states[e] = b.state()
        if risk < 40 and far < 4 and not r["flag"] and r["agent_id"] and its:
            host.take(at, its)
            states["host", r["agent_id"]] = host.state()
    return out, states


@pytest.fixture(scope="module")
def rows():
    draw, out, start = random.Random(2), [], datetime(2024, 1, 1)
    for n in range(700):
        ts = start + timedelta(minutes=n * 35 + draw.choice([0, 0, 1, 20]))
        late = draw.choice([0] * 8 + [5, 50, 90])  # hours
        burst = draw.random() < 0.08
        out.append({
            "payload_id": n, "username": draw.choice(["ann", "Bob", "cy", "", None]), "role_name": draw.choice(["dev", "ops"]), "agent_id": draw.choice(["H1", "H2", None]),
            "ts": ts - timedelta(hours=late), "arrived": ts if n % 9 else start + timedelta(minutes=(n - 1) * 35), "flag": draw.choice([False] * 20 + [True]), "file_access_count": draw.choice([10.0, 30.0, 35.0]) * (9 if burst else 1) if draw.random() > 0.2 else None,
            "bytes_rate": draw.choice([0.1, 0.2, float("nan"), 3.0 if burst else 0.15]), "odd": float(draw.randrange(5)), "auth_rate_300s": draw.choice([0.0, 0.3, 9.0 if burst else 0.2]),
        })
    return out


SCHEMA = "payload_id long, username string, role_name string, agent_id string, ts timestamp_ntz, arrived timestamp_ntz, flag boolean, file_access_count double, bytes_rate double, odd double, auth_rate_300s double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA).repartition(3)


def test_batch_equals_the_walk(spark, rows):
    want, states = walk(rows)
    got, after, rounds = L.learn(frame(spark, rows), score, USERS, HOSTS)
    assert {r.payload_id: pytest.approx(r.risk_score, abs=1e-9) for r in got.collect()} == want
    assert sum(v >= 40 for v in want.values()) > 20 and rounds > 2
    mature = [k for k, s in states.items() if any(n >= 5 for n in L.Baseline(k[0], s).samples.values())]
    assert {k for k, _ in mature} == {"user", "role", "host"}
    told = {(r.kind, r.entity): r.state for r in after.collect()}
    for key, state in states.items():
        a, b = L.Baseline(key[0], told[key]).__dict__, L.Baseline(key[0], state).__dict__
        assert (a["samples"], a["last"], a["day"], a["members"], a["missing"], a["taken"]) == (b["samples"], b["last"], b["day"], b["members"], b["missing"], b["taken"])
        assert a["mean"] == pytest.approx(b["mean"]) and a["std"] == pytest.approx(b["std"])


def test_micro_batches_continue_the_batch(spark, rows):
    ordered = sorted(rows, key=lambda r: (r["arrived"], r["payload_id"]))
    want, _ = walk(ordered)
    states, got = None, {}
    for part in (ordered[:250], ordered[250:251], ordered[251:]):
        scored, states, _ = L.learn(frame(spark, part), score, USERS, HOSTS, states)
        got |= {r.payload_id: r.risk_score for r in scored.collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_nothing_and_nobody(spark, rows):
    none, states, _ = L.learn(frame(spark, rows[:1]).where("false"), score, USERS, HOSTS)
    assert none.count() == 0 and states.count() == 0
    nobody = [r | {"username": None, "agent_id": ""} for r in rows[:5]]
    scored, states, rounds = L.learn(frame(spark, nobody), score, USERS, HOSTS)
    assert {r.risk_score for r in scored.collect()} == {0.0} and states.count() == 0


def test_a_member_is_forgotten_after_two_days():
    b, hour = L.Baseline("role"), 3_600_000_000
    assert b.take(100 * hour, {"odd": 1.0}, "ann") and not b.take(99 * hour, {"odd": 1.0}, "ann") and not b.take(100 * hour + hour - 1, {"odd": 1.0}, "ann")
    assert b.take(148 * hour, {"odd": 1.0}, "bob") and set(b.members) == {"bob"}
    assert b.take(99 * hour, {"odd": 1.0}, "ann")


def test_a_large_cohort_is_walked_in_time_linear_in_its_rows():
    b, start = L.Baseline("role"), time.perf_counter()
    assert all(b.take(n * 1_000_000, {"odd": 1.0}, f"user-{n}") for n in range(30_000))
    assert time.perf_counter() - start < 5 and len(b.members) == 30_000
    assert b.take(30_000_000_000 + L.FORGOTTEN, {"odd": 1.0}, "ann") and set(b.members) == {"ann"}
    again = L.Baseline("role", b.state())
    assert again.state() == b.state() and again.take(30_000_000_000 + 2 * L.FORGOTTEN, {"odd": 1.0}, "bob") and set(again.members) == {"bob"}


def test_a_stream_equals_the_walk_also_when_a_batch_runs_twice(spark, rows, tmp_path):
    from riskloom.streaming import scoring as C

    ordered = sorted(rows, key=lambda r: (r["arrived"], r["payload_id"]))[:400]
    want, last = walk(ordered)
    for n, part in enumerate((ordered[:150], ordered[150:], [])):
        if part:
            frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        C.start(stream, f"{tmp_path}/out", f"{tmp_path}/state", score, USERS, HOSTS, availableNow=True).awaitTermination()
    C.take(frame(spark, ordered[150:]), 1, f"{tmp_path}/out", score, USERS, HOSTS)
    got = {r.payload_id: r.risk_score for r in spark.read.parquet(f"{tmp_path}/out/scored").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    held = {(r.kind, r.entity): L.Baseline(r.kind, r.state).taken for r in C.states(spark, f"{tmp_path}/out").collect()}
    assert {k: held[k] for k in last} == {k: L.Baseline(k[0], s).taken for k, s in last.items()}


def test_later_rounds_score_only_what_has_moved(spark, rows):
    scored = []

    def counted(df):
        scored.append(df.count())
        return score(df)

    L.learn(frame(spark, rows), counted, USERS, HOSTS)
    assert scored[0] == scored[-1] == len(rows) and min(scored) < len(rows) / 4


def test_states_alone_are_learnt_without_whole_rows(spark, rows):
    scored, states, _ = L.learn(frame(spark, rows[:300]), score, USERS, HOSTS, whole=False)
    assert scored.columns == ["payload_id", "risk_score", "burst", "sure"] and scored.count() == 300
    _, after = walk(rows[:300])
    held = {(r.kind, r.entity): L.Baseline(r.kind, r.state).taken for r in states.collect()}
    assert {k: held[k] for k in after} == {k: L.Baseline(k[0], s).taken for k, s in after.items()}

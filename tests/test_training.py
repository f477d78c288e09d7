"""The host model's training: folds that see no later day, inputs, cut-offs over all values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import daily as D
from riskloom.operators import models as M
from riskloom.operators import training as T

SPEC = B.Spec(rounds=3, depth=2, child=1.0, ridge=1.0, lasso=0.0, gain=0.0, rate=0.3)


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h in range(14):
        for d in range(1, 27):
            if (h, d) == (3, 20):
                continue  # a gap
            x = rng.poisson(5, 40).astype(float)
            bad = rng.random() < 0.15
            if bad:
                x[33] += 9
            rows.append((f"host-{h}", f"2024-01-{d:02}", d, "CREDENTIAL_DUMP" if bad else "BENIGN", *map(float, x)))
    return spark.createDataFrame(rows, "hostname string, review_date string, day_index int, label string, " + ", ".join(f"{f} double" for f in D.FEATURES)).withColumn("review_date", F.col("review_date").cast("date"))


CLASSES = ("BENIGN", "CREDENTIAL_DUMP")


def test_no_block_sees_its_own_or_later_days(spark, days):
    out, _ = T.chronological(days, [10, 18], SPEC, trees=20, classes=CLASSES)
    got = out.toPandas().set_index(["hostname", "review_date"])
    assert len(got) == 14 * 16 - 1 and set(got["block"]) == {0, 1}
    # the first block is the same when all days after the cut are other days, in sample it isn't
    other = days.withColumn("lsass_handle_request_count", F.when(F.col("day_index") > 18, 99.0).otherwise(F.col("lsass_handle_request_count"))).withColumn("label", F.when(F.col("day_index") > 18, "BENIGN").otherwise(F.col("label")))
    again = T.chronological(other, [10, 18], SPEC, trees=20, classes=CLASSES)[0].toPandas().set_index(["hostname", "review_date"])
    first = got[got["block"] == 0]
    np.testing.assert_allclose(again.loc[first.index, "threat"], first["threat"], atol=1e-12)
    np.testing.assert_allclose(again.loc[first.index, "risk"], first["risk"], atol=1e-12)
    inside = T.fold(days, F.col("day_index") <= 26, F.col("day_index").between(11, 18), SPEC, (M.SEED,), trees=20, classes=CLASSES).toPandas().set_index(["hostname", "review_date"])
    assert np.abs(inside.loc[first.index, "threat"] - first["threat"]).max() > 1e-3


def test_windows_stay_inside_a_block_and_the_ridge_sees_normal_ones_alone(spark, days):
    out, model = T.chronological(days, [10, 18], SPEC, trees=20, classes=CLASSES)
    got = out.toPandas().sort_values(["hostname", "review_date"])
    windows, normal = {}, []
    for host, g in got.groupby("hostname"):
        for block, b in g.groupby("block"):
            b = b.reset_index(drop=True)
            for i in range(7, len(b)):
                eight = b.iloc[i - 7 : i + 1]
                if all((y - x).days == 1 for x, y in zip(eight["review_date"], eight["review_date"][1:])):
                    windows[host, eight["review_date"].iloc[-1]] = eight["fused"].iloc[:7].to_numpy()
                    if (eight["label"] == "BENIGN").all():
                        normal.append((windows[host, eight["review_date"].iloc[-1]], eight["fused"].iloc[7]))
    known = got[got["forecast"].notna()]
    assert {(r.hostname, r.review_date) for r in known.itertuples()} == set(windows) and windows
    assert got[got["forecast"].isna()]["error"].isna().all()
    # the same ridges in one process, from the normal windows
    y, weights = np.array([t for _, t in normal]), M.layers()
    states = M.hidden_states(np.array([h for h, _ in normal]), weights)
    ridges = []
    for x in states:
        mx, my = x.mean(axis=0), y.mean()
        slope = np.linalg.solve((x - mx).T @ (x - mx) + M.ALPHA * np.eye(x.shape[1]), (x - mx).T @ (y - my))
        ridges.append((slope, my - mx @ slope))
    for (a, b), (c, d) in zip(model, ridges):
        np.testing.assert_allclose(a, c, atol=1e-9)
        assert b == pytest.approx(d)
    for r in known.itertuples():
        said = np.median([s[0] @ slope + base for s, (slope, base) in zip(M.hidden_states(windows[r.hostname, r.review_date][None], weights), ridges)])
        assert r.forecast == pytest.approx(min(1.0, max(0.0, said)), abs=1e-9) and r.error == pytest.approx(max(r.fused - r.forecast, 0.0), abs=1e-9)


@pytest.mark.parametrize("representation", T.REPRESENTATIONS)
def test_inputs_of_each_representation(spark, days, representation):
    placed = days.withColumns({d: F.lit(0.1) for d in T.DOMAINS} | {"risk": F.col("decoy_access_count") / 20, "peak": F.lit(0.2)})
    made, names = T.inputs(placed, representation)
    got = made.toPandas().sort_values(["hostname", "review_date"])
    assert len(names) == 40 and got[names].notna().all().all()
    host = got[got["hostname"] == "host-3"].reset_index(drop=True)
    for f in D.KEPT:
        logs = np.log1p(host[f].to_numpy())
        for i, row in host.iterrows():
            past = [logs[j] for j in range(max(0, i - 7), i) if (row["review_date"] - host["review_date"][j]).days == i - j and all((host["review_date"][k + 1] - host["review_date"][k]).days == 1 for k in range(j, i))]
            far = 0.0 if len(past) < 3 else float(np.clip((logs[i] - np.mean(past)) / max(np.std(past, ddof=1), 0.25), -8, 8))
            want = far if representation == "context" or (representation == "hybrid" and f in T.RELATIVE) else logs[i]
            assert row[f"in_{f}"] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="no representation"):
        T.inputs(placed, "other")


def chosen_by_brute_force(rows, cohorts, most=0.03):
    best = None
    for cut in sorted({s for _, _, s in rows if s is not None and s == s} | {T.NEVER}):
        balanced, fine = [], True
        for c in cohorts:
            pos, neg = ([s for k, p, s in rows if k == c and p == v and s is not None and s == s] for v in (True, False))
            tp, fp = sum(s >= cut for s in pos), sum(s >= cut for s in neg)
            fine &= fp / len(neg) <= most
            balanced.append(0.5 * (tp / len(pos) + 1 - fp / len(neg)))
        key = (min(balanced), sum(balanced) / len(balanced), cut)
        if fine and (best is None or key > best):
            best = key
    return best[2]


def test_cut_off_by_brute_force(spark):
    rng = np.random.default_rng(8)
    for shift in (0.0, 0.4):
        rows = [(c, bool(p), float(np.round(rng.normal(0.4 + shift * p, 0.15), 2))) for c in ("a", "b") for p in rng.random(300) < 0.2]
        rows += [("a", True, None), ("b", False, float("nan")), ("other", False, 0.99)]
        df = spark.createDataFrame(rows, "cohort string, positive boolean, score double").repartition(4)
        assert T.cut_off(df, ["a", "b"]) == chosen_by_brute_force(rows, ["a", "b"])
    one = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.9)], "cohort string, positive boolean, score double")
    assert T.cut_off(one, ["a"]) == T.NEVER


def test_heads_apply_a_cut_off_or_abstain(spark, days):
    made = days.withColumn("one", F.col("lsass_handle_request_count")).select("hostname", "review_date", "day_index", "one", "decoy_access_count")
    rules = {"seen": "one > 11", "never": "one > 1000", "noise": "decoy_access_count = 7 and day_index % 9 = 4"}
    out, cuts = T.heads(made, ["one", "day_index"], rules, F.col("hostname") < "host-3", SPEC, ["hostname", "review_date"])
    got = out.toPandas()
    assert len(got) == 3 * days.count() and cuts["seen"] is not None and cuts["never"] is None
    seen = got[got["behaviour"] == "seen"]
    assert (seen["label"] == (seen["probability"] >= cuts["seen"])).all() and seen["label"].any() and set(seen["status"]) == {"calibrated_threshold_applied"}
    truth = {(r.hostname, r.review_date): r.one > 11 for r in made.collect()}
    assert np.mean([truth[r.hostname, r.review_date] == r.label for r in seen.itertuples()]) > 0.95
    never = got[got["behaviour"] == "never"]
    assert never["probability"].isna().all() and not never["label"].any() and set(never["status"]) == {"abstain_calibration_unmet"}


def test_without_normal_days_every_day_is_scored_and_nothing_is_said_of_anomalies(spark, days):
    marked = days.withColumn("label", F.when(F.col("label") == "BENIGN", "DATA_HOARDING").otherwise(F.col("label")))
    out, model = T.chronological(marked, [10, 18], SPEC, trees=5, classes=("BENIGN", "CREDENTIAL_DUMP", "DATA_HOARDING"))
    got = out.toPandas()
    assert len(got) == 14 * 16 - 1 and (got["threat"] == 1.0).all() and model == []
    assert got[["risk", "fused", "forecast", "error"]].isna().all().all()
    one, _ = T.chronological(marked.where("label = 'DATA_HOARDING'"), [10], SPEC, trees=5, classes=("BENIGN", "DATA_HOARDING"))
    assert (one.toPandas()["threat"] == 1.0).all()
    made, names = T.inputs(T.placed(marked, marked, 5))
    heads, _ = T.heads(made, names, {"seen": "lsass_handle_request_count > 11"}, F.col("hostname") < "host-3", SPEC, ["hostname", "review_date"])
    assert heads.where("probability is not null").count() == marked.count()


def test_the_chosen_cut_off_is_swept_once(spark, monkeypatch):
    from riskloom.plans import training as plan

    calls, sweep = [], T.sweep
    monkeypatch.setattr(T, "sweep", lambda *a: calls.append(a) or sweep(*a))
    got = plan.cutoff_choice(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and len(got) == 1
    assert got[0].cut == T.cut_off(*calls[0])

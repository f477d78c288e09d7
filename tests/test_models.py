"""Forests, forecast, keystroke protocols and what teaches a baseline, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import baseline as B
from riskloom.operators import keystrokes as K
from riskloom.operators import models as M


def test_anomaly_walks_each_tree_as_a_plain_walk_does():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 4)), [[9.0, 9.0, 9.0, 9.0]]])
    model = M.forest(x, trees=20, rows=64)
    feature, cut, ends = model["trees"]

    def walk(t, row, at=0):
        return ends[t][at] if feature[t][at] < 0 else walk(t, row, 2 * at + 1 + int(row[feature[t][at]] > cut[t][at]))

    plain = [2.0 ** (-np.mean([walk(t, r) for t in range(20)]) / model["norm"]) for r in x]
    assert np.allclose(M.anomaly(model, x), plain)
    assert np.argmax(plain) == 300


def test_forests_of_equal_rows_and_of_one_row():
    for x in (np.ones((5, 2)), np.ones((1, 2))):
        assert np.isfinite(M.anomaly(M.forest(x, trees=3), x)).all()


def test_forests_score_every_row_and_take_null_as_zero(spark):
    rows = spark.createDataFrame([(i, float(i % 5), None if i % 7 == 0 else float(i % 3)) for i in range(200)] + [(200, 5000.0, 5000.0)], "id long, a double, b double")
    domains = {"one": ["a", "b"], "two": ["b"]}
    scores = M.score_forests(rows, M.fit_forests(rows, domains, ["id"], trees=30), domains, ["id"])
    placed = M.upper_tenth(scores, F.col("id") >= 0, ["one", "two"]).toPandas().set_index("id")
    assert len(placed) == 201 and placed["one"].between(0, 1).all()
    assert placed.loc[200, "risk"] == placed["risk"].max() == 1.0
    assert M.score_forests(rows.limit(0), M.fit_forests(rows, domains, ["id"], trees=3), domains, ["id"]).count() == 0


def test_forecast_is_the_ridge_of_all_rows_whatever_the_partitions(spark):
    rng = np.random.default_rng(3)
    history, y = rng.random((120, 7)), rng.random(120)
    rows = spark.createDataFrame([(i, float(y[i]), [float(v) for v in history[i]]) for i in range(120)], "id long, y double, history array<double>").repartition(5, "id")
    said = M.forecast(rows, M.fit_forecast(rows, "y", alpha=2.0), ["id"]).toPandas().sort_values("id")["forecast"].to_numpy()
    plain = []
    for d in M.hidden_states(history, M.layers()):
        dc, yc = d - d.mean(axis=0), y - y.mean()
        plain.append(dc @ np.linalg.solve(dc.T @ dc + 2.0 * np.eye(d.shape[1]), dc.T @ yc) + y.mean())
    assert np.allclose(said, np.median(plain, axis=0), atol=1e-8)


def _streams(spark, lengths):
    rows = [(f"u{i}", [float(k) for k in range(n)], [float(k) for k in range(n)]) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "identity string, dwell array<double>, flight array<double>")


def test_verification_shares_no_key_and_impostors_are_others(spark):
    v = K.verification(_streams(spark, [200, 150, 90, 79])).toPandas()
    assert set(v["identity"]) == {"u0", "u1"}  # of 90 pairs 36 are left to probe by, two windows; 79 are too few
    for who, mine in v.groupby("identity"):
        kinds = {k: g for k, g in mine.groupby("kind")}
        assert max(map(max, kinds["enroll"]["dwell"])) < min(map(min, kinds["genuine"]["dwell"]))
        assert len(kinds["impostor"]) == len(kinds["genuine"]) and who not in set(kinds["impostor"]["source"])
    assert set(K.verification(_streams(spark, [200])).toPandas()["kind"]) == {"enroll", "genuine"}
    assert K.verification(_streams(spark, [200]).limit(0)).count() == 0


def test_protocol_holds_identities_or_halves_out(spark):
    p = K.protocol(_streams(spark, [100] * 10)).toPandas()
    assert set(p["protocol"]) == {"open-set"} and p["identity"].is_unique and (p["side"] == "bench").sum() == 3
    p = K.protocol(_streams(spark, [101, 30])).toPandas()
    assert set(p["protocol"]) == {"temporal"} and set(p["identity"]) == {"u0"}  # halves of fifteen are shorter than a window
    assert sorted(len(d) for d in p["dwell"]) == [50, 51]


def test_what_teaches_a_baseline(spark):
    rows = spark.createDataFrame([(39.9, False, False), (40.0, False, False), (10.0, True, False), (10.0, False, True)], "risk double, burst boolean, dump boolean")
    said = rows.select(B.teaches_user(F.col("risk")), B.teaches_host(F.col("risk"), F.col("burst"), [F.col("dump")])).collect()
    assert [tuple(r) for r in said] == [(True, True), (False, False), (True, False), (True, False)]
    chosen = B.selected(spark.createDataFrame([(1, "3", "x", float("nan"))], "id int, bytes_sent string, file_access_count string, daily_http_request_count double"), ["id"], B.USER_FEATURES)
    assert [tuple(r) for r in chosen.collect()] == [(1, "bytes_sent", 3.0)]


def test_splits_are_whole_hundredths(spark):
    got = K.splits(spark.range(90_000).select(F.format_string("u%06d", "id").alias("identity"))).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 63_000, "val": 13_500, "test": 13_500}

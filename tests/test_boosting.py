"""Boosted trees against a plain version in one process, and their attributions against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting as B

SPEC = B.Spec(rounds=12, depth=3, child=2.0, ridge=1.0, lasso=0.1, gain=0.01, rate=0.3)
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    n = 900
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.exponential(size=n)], axis=1)
    label = np.where(x[:, 0] + x[:, 1] > 3.5, "up", np.where(x[:, 2] > 1.5, "far", "calm"))
    rows = [(i, *map(float, v), str(y)) for i, (v, y) in enumerate(zip(x, label))]
    rows += [(n, float("nan"), None, 0.1, "calm"), (n + 1, 0.0, 1.0, 0.1, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label string").repartition(5)


def plain(rows, cuts, classes, spec, seed):
    """The same boosting in plain loops over all rows at once: each node's split by trying every feature and bin."""
    ids, x, y, w = rows
    margins, rounds = np.zeros((len(y), len(classes))), []
    for number in range(spec.rounds):
        g, h = B.gradients(margins, y, w, B.drawn(ids, seed, number, spec.rows))
        trees = []
        for c in range(len(classes)):
            tree, todo = B.new_tree(spec.depth), [(0, np.arange(len(y)), 0)]
            allowed = B.columns_of(seed, number, c, x.shape[1], spec.columns)
            while todo:
                node, at, level = todo.pop()
                best, G, H = (spec.gain, None), g[at, c].sum() / B.UNIT, h[at, c].sum() / B.UNIT
                score = lambda a, b: max(abs(a) - spec.lasso, 0) ** 2 / (b + spec.ridge)
                tree[2][node], tree[3][node] = B.leaf(G, H, spec), H
                if level == spec.depth:
                    continue
                for j in allowed:
                    for b in range(B.BINS - 1):
                        left = x[at, j] <= b
                        gl, hl = g[at[left], c].sum() / B.UNIT, h[at[left], c].sum() / B.UNIT
                        if hl >= spec.child and H - hl >= spec.child:
                            gain = score(gl, hl) + score(G - gl, H - hl) - score(G, H)
                            if gain > best[0]:
                                best = gain, (j, b)
                if best[1]:
                    j, b = best[1]
                    tree[0][node], tree[1][node], tree[2][node] = j, b, 0.0
                    left = x[at, j] <= b
                    todo += [(2 * node + 1, at[left], level + 1), (2 * node + 2, at[~left], level + 1)]
            trees.append(tree)
        rounds.append(trees)
        margins = B.add_margins(margins, [trees], x, spec.depth)
    return rounds


def test_trees_are_those_of_the_plain_version(spark, table, monkeypatch):
    monkeypatch.setattr(B, "EVERY", 5)
    monkeypatch.setattr(B, "ROWS", 200)
    model = B.fit(table, FEATURES, "label", ["id"], SPEC, seed=7)
    known = table.where("label is not null").withColumn("h", F.xxhash64("id")).toPandas()
    assert model.classes == ["calm", "far", "up"]
    weights = B.class_weights(known["label"].value_counts().to_dict(), SPEC.cap)
    y = known["label"].map({c: i for i, c in enumerate(model.classes)}).to_numpy()
    rows = known["h"].to_numpy(np.int64), B.binned(known[FEATURES].to_numpy(float), model.cuts), y, known["label"].map(weights).to_numpy(float)
    want = plain(rows, model.cuts, model.classes, SPEC, 7)
    assert len(model.rounds) == SPEC.rounds and any((t[0] >= 0).sum() > 1 for r in want for t in r)
    for got, ours in zip(model.rounds, want):
        for a, b in zip(got, ours):
            assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
            np.testing.assert_allclose(a[2], b[2], atol=1e-9)
            np.testing.assert_allclose(a[3], b[3], atol=1e-6)


def test_partitions_do_not_matter_and_classes_are_told_apart(spark, table):
    one, other = (B.fit(t, FEATURES, "label", ["id"], SPEC, seed=3) for t in (table.coalesce(1), table.repartition(7)))
    assert all((a[2] == b[2]).all() for r, s in zip(one.rounds, other.rounds) for a, b in zip(r, s))
    more = B.fit(table, FEATURES, "label", ["id"], SPEC, seed=4)
    said = B.probabilities(table, [one, more], ["id", "label"]).toPandas()
    p = said[["p_calm", "p_far", "p_up"]].to_numpy()
    np.testing.assert_allclose(p.sum(axis=1), 1.0)
    known = said["label"].notna()
    assert (np.array(["calm", "far", "up"])[p[known].argmax(axis=1)] == said["label"][known]).mean() > 0.93
    with pytest.raises(ValueError, match="every class"):
        B.fit(table, FEATURES, "label", ["id"], SPEC, classes=["calm", "absent"])
    with pytest.raises(ValueError, match="every class"):
        B.fit(table.where("false"), FEATURES, "label", ["id"], SPEC)


def test_weights_are_capped():
    assert B.class_weights({"a": 900, "b": 90, "c": 10}, 5.0) == pytest.approx({"a": 1000 / 2700, "b": 1000 / 270, "c": 5.0})


def expectation(tree, row, known, at=0):
    """A tree's mean over what is not known, by covers."""
    f = tree[0][at]
    if f < 0:
        return tree[2][at]
    if f in known:
        return expectation(tree, row, known, 2 * at + 1 + int(row[f] > tree[1][at]))
    both = [(tree[3][2 * at + 1 + s] / tree[3][at], expectation(tree, row, known, 2 * at + 1 + s)) for s in (0, 1)]
    return sum(a * b for a, b in both)


def test_attributions_are_those_of_all_subsets(spark, table):
    model = B.fit(table, FEATURES, "label", ["id"], SPEC, seed=5)
    rows = table.where("id % 30 = 0")
    x = rows.toPandas()
    raw = x[FEATURES].to_numpy(float)
    got = B.attributions(model, raw)
    np.testing.assert_allclose(got.sum(axis=2), B.margins_of(model, raw), atol=1e-6)
    b, n = B.binned(raw, model.cuts), len(FEATURES)
    for i in range(len(raw)):
        for c in range(3):
            whole = lambda known: sum(expectation(trees[c], b[i], known) for trees in model.rounds)
            for f in range(n):
                rest = [j for j in range(n) if j != f]
                want = sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (whole({*s, f}) - whole(set(s))) for k in range(n) for s in combinations(rest, k))
                assert got[i, c, f] == pytest.approx(want, abs=1e-9)
    told = B.explain(rows, [model], ["id"]).groupBy("id", "class").agg(F.sum("contribution").alias("m")).toPandas().set_index(["id", "class"])["m"]
    margins = B.margins_of(model, raw)
    for i, row_id in enumerate(x["id"]):
        assert told[row_id, "up"] == pytest.approx(margins[i, 2], abs=1e-6)

"""Boosted trees of several classes over histograms, fitted by Spark; their probabilities and exact attributions.

Features are cut into bins once. Rows lie in blocks (binned features, class, weight, margins), written to the shared folder.
A level of a round's trees, one a class, is one pass: tasks add up gradients and Hessians by class, node, feature and bin, a grouping adds
the tasks' sums and finds each node's best split, and only the splits reach the driver (at most classes x 2**depth rows). Gradients are summed as
whole multiples of 2**-30, so sums, splits and trees are the same for any order of rows and partitions. Margins are written
again every ``EVERY`` rounds, so a pass, or a task that a lost executor had, applies that many rounds of trees at most.

Nulls and NaN in features count as the lowest value, as do all below the first cut. Rows without a class are left out of fitting.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskloom.sources.files import shared_folder

#: Bins of a feature, rows of a block, rounds between two writings of the margins, the unit of sums of gradients.
BINS, ROWS, EVERY, UNIT = 64, 4096, 10, float(1 << 30)


@dataclass(frozen=True)
class Spec:
    """The host model's settings. ``child``: least Hessian of a node; ``cap``: greatest weight of a class."""

    rounds: int = 240
    depth: int = 3
    child: float = 40.0
    cap: float = 5.0
    rate: float = 0.035
    ridge: float = 40.0
    lasso: float = 3.0
    gain: float = 0.5
    rows: float = 0.75
    columns: float = 0.8


@dataclass
class Trees:
    """``rounds[r][c]``: feature (-1 at a leaf), bin, value and cover of each place of the tree of round r and class c."""

    features: list[str]
    classes: list[str]
    cuts: list[np.ndarray]
    depth: int
    rounds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)


def class_weights(counts: dict[str, int], cap: float) -> dict[str, float]:
    """The rarer a class the heavier its rows, up to ``cap``."""
    total = sum(counts.values())
    return {c: min(total / (len(counts) * n), cap) for c, n in counts.items()}


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of cuts at or below each value; NaN counts as none."""
    return np.stack([np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j], side="right")) for j, c in enumerate(cuts)], axis=1).astype(np.uint8) if len(cuts) else np.zeros((len(x), 0), np.uint8)


def place_of(tree, x: np.ndarray, depth: int) -> np.ndarray:
    """Where each binned row ends in a tree that may still be growing."""
    feature, cut, at, rows = tree[0], tree[1], np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[at]
        at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]), at)
    return at


def add_margins(margins: np.ndarray, rounds: list, x: np.ndarray, depth: int) -> np.ndarray:
    for trees in rounds:
        for c, tree in enumerate(trees):
            margins[:, c] += tree[2][place_of(tree, x, depth)]
    return margins


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, w: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives by class, in whole units; of rows not drawn in this round zero."""
    p = softmax(margins)
    g = (p - (y[:, None] == np.arange(p.shape[1]))) * w[:, None]
    h = np.maximum(2.0 * p * (1.0 - p) * w[:, None], 1e-16)
    whole = lambda v: np.rint(np.where(kept[:, None], v, 0.0) * UNIT).astype(np.int64)
    return whole(g), whole(h)


def drawn(ids: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Rows of a round, by a hash of their own number: the same whichever task asks."""
    return np.array([xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=(seed * 1_000_003 + number) & (2**64 - 1)) for i in ids.tolist()], np.uint64) < np.uint64(min(share, 1.0) * (2**64 - 1)) if share < 1 else np.ones(len(ids), bool)


def columns_of(seed: int, number: int, c: int, n: int, share: float) -> np.ndarray:
    """The features that a tree may use."""
    return np.sort(np.random.default_rng([seed, number, c]).choice(n, max(1, int(n * share)), replace=False))


def histogram(x: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: list[int]) -> dict[int, np.ndarray]:
    """For each open node the sums by (feature, bin) of gradients and Hessians, as whole numbers."""
    out = {}
    for node in nodes:
        rows = np.flatnonzero(at == node)
        if len(rows):
            # whole numbers below 2**53 within a block, so sums of doubles are exact
            sums = [[np.bincount(x[rows, j], v[rows], BINS) for j in range(x.shape[1])] for v in (g, h)]
            out[node] = np.array(sums).astype(np.int64)
    return out


def _score(g, h, spec: Spec):
    return np.square(np.sign(g) * np.maximum(np.abs(g) - spec.lasso, 0.0)) / (h + spec.ridge)


def leaf(g: float, h: float, spec: Spec) -> float:
    return float(-np.sign(g) * max(abs(g) - spec.lasso, 0.0) / (h + spec.ridge) * spec.rate)


def best_split(sums: np.ndarray, allowed: np.ndarray, spec: Spec) -> tuple[int, int, list[float]]:
    """(feature, bin, [G and H of the left, of the right side]); feature -1 where no split gains more than ``spec.gain``. Ties: first feature, first bin."""
    total = sums[:, allowed[0]].sum(axis=1) / UNIT
    left = np.cumsum(sums[:, allowed], axis=2)[:, :, :-1] / UNIT
    right = total[:, None, None] - left
    gain = _score(left[0], left[1], spec) + _score(right[0], right[1], spec) - _score(total[0], total[1], spec)
    gain = np.where((left[1] >= spec.child) & (right[1] >= spec.child), gain, -np.inf)
    j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[j, b] > spec.gain:
        return -1, 0, [float(total[0]), float(total[1]), 0.0, 0.0]
    return int(allowed[j]), int(b), [float(v) for v in (left[0, j, b], left[1, j, b], right[0, j, b], right[1, j, b])]


def new_tree(depth: int):
    size = 2 ** (depth + 1) - 1
    return np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)


def split_node(tree, node: int, split, spec: Spec) -> list[int]:
    """Write a split into a tree; the places that it opens."""
    feature, cut, value, cover = tree
    f, b, (gl, hl, gr, hr) = split
    if f < 0:
        if node == 0:
            value[0], cover[0] = leaf(gl, hl, spec), hl
        return []
    feature[node], cut[node], value[node] = f, b, 0.0
    cover[node] = hl + hr
    for side, g, h in ((1, gl, hl), (2, gr, hr)):
        value[2 * node + side], cover[2 * node + side] = leaf(g, h, spec), h
    return [2 * node + 1, 2 * node + 2]


# -- fitting --------------------------------------------------------------------------------------


def quantile_cuts(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """At most ``BINS`` - 1 cuts of each feature; a feature with few values is cut at each."""
    steps = [i / BINS for i in range(1, BINS)]
    got = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), F.array(*map(F.lit, steps)), 10_000).alias(f) for f in features)).first()
    return [np.unique(np.array([v for v in (got[f] or []) if v is not None and v == v], float)) for f in features]


_BLOCKS = "block long, ids binary, x binary, y binary, w binary, margins binary"
_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "x", "y", "w", "margins"))])


def _write(df: DataFrame, spark) -> DataFrame:
    path = f"{shared_folder(spark)}/boosting-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _blocks(rows: DataFrame, features: list[str], cuts, label: str, key: list[str], weights: dict[str, float]) -> DataFrame:
    names = list(weights)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at : at + ROWS]
                y = part["__y"].map({c: i for i, c in enumerate(names)}).to_numpy(np.int64)
                x = binned(part[features].to_numpy(float), cuts)
                yield pd.DataFrame([[0, part["__id"].to_numpy(np.int64).tobytes(), x.tobytes(), y.tobytes(), np.array([weights[names[i]] for i in y], float).tobytes(), np.zeros((len(y), len(names))).tobytes()]], columns=_ARROW.names)

    kept = rows.where(F.col(label).isin(names)).select(F.xxhash64(*key).alias("__id"), F.col(label).alias("__y"), *(F.col(f).cast("double").alias(f) for f in features))
    return kept.mapInPandas(pack, _BLOCKS)


def _opened(row: dict, n_features: int, n_classes: int):
    read = lambda c, t: np.frombuffer(row[c], t)
    y = read("y", np.int64)
    return read("ids", np.int64), read("x", np.uint8).reshape(len(y), n_features), y, read("w", float), read("margins", float).reshape(len(y), n_classes).copy()


def fit(rows: DataFrame, features: list[str], label: str, key: list[str], spec: Spec | None = None, classes: list[str] | None = None, seed: int = 20_261_021) -> Trees:
    """Trees that tell ``label``'s classes apart by ``features``; ``key`` names a row for the drawing of rows. Every class must have rows."""
    spec, spark = spec or Spec(), rows.sparkSession
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    classes = classes or sorted(counts)
    if any(not counts.get(c) for c in classes) or not classes:
        raise ValueError(f"every class needs rows: {counts}")
    weights = class_weights({c: counts[c] for c in classes}, spec.cap)
    cuts = quantile_cuts(rows.where(F.col(label).isin(classes)), features)
    model, written, k = Trees(features, classes, cuts, spec.depth), 0, len(classes)
    data = _write(_blocks(rows, features, cuts, label, key, weights), spark)
    for number in range(spec.rounds):
        if number - written == EVERY:
            data, written = _write(_with_margins(data, model, written), spark), number
        trees = [new_tree(spec.depth) for _ in classes]
        open_ = {c: [0] for c in range(k)}
        for _ in range(spec.depth):
            splits = _level(data, model, written, trees, open_, number, seed, spec)
            open_ = {c: [p for node in nodes for p in split_node(trees[c], node, splits[c, node], spec)] for c, nodes in open_.items()}
            if not any(open_.values()):
                break
        model.rounds.append(trees)
    return model


def _with_margins(data: DataFrame, model: Trees, written: int) -> DataFrame:
    rounds, n, k, depth = model.rounds[written:], len(model.features), len(model.classes), model.depth

    def task(batches):
        for b in batches:
            for row in b.to_pylist():
                _, x, _, _, margins = _opened(row, n, k)
                yield pa.RecordBatch.from_pylist([row | {"margins": add_margins(margins, rounds, x, depth).tobytes()}], _ARROW)

    return data.mapInArrow(task, _BLOCKS)


def _level(data: DataFrame, model: Trees, written: int, trees, open_: dict[int, list[int]], number: int, seed: int, spec: Spec) -> dict:
    """The best split of every open node of every class."""
    rounds, n, k = model.rounds[written:], len(model.features), len(model.classes)

    def sums(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                ids, x, y, w, margins = _opened(row, n, k)
                g, h = gradients(add_margins(margins, rounds, x, spec.depth), y, w, drawn(ids, seed, number, spec.rows))
                for c, nodes in open_.items():
                    if nodes:
                        for node, s in histogram(x, place_of(trees[c], x, spec.depth), g[:, c], h[:, c], nodes).items():
                            held[c, node] = held[c, node] + s if (c, node) in held else s
        for (c, node), s in held.items():
            yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int32()), "node": pa.array([node], pa.int32()), "sums": pa.array([s.tobytes()], pa.binary())})

    def split(t: pa.Table) -> pa.Table:
        c, node = t.column("c")[0].as_py(), t.column("node")[0].as_py()
        total = sum(np.frombuffer(s, np.int64) for s in t.column("sums").to_pylist()).reshape(2, n, BINS)
        f, b, sides = best_split(total, columns_of(seed, number, c, n, spec.columns), spec)
        return pa.table({"c": pa.array([c], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([f], pa.int32()), "bin": pa.array([b], pa.int32()), "sides": pa.array([sides], pa.list_(pa.float64()))})

    # a group is one node: a row of 2 x features x BINS sums from each task
    found = data.mapInArrow(sums, "c int, node int, sums binary").groupBy("c", "node").applyInArrow(split, "c int, node int, feature int, bin int, sides array<double>").collect()
    out = {(r.c, r.node): (r.feature, r.bin, list(r.sides)) for r in found}
    return {(c, node): out.get((c, node), (-1, 0, [0.0] * 4)) for c, nodes in open_.items() for node in nodes}


# -- using ----------------------------------------------------------------------------------------


def margins_of(model: Trees, x: np.ndarray) -> np.ndarray:
    return add_margins(np.zeros((len(x), len(model.classes))), model.rounds, binned(x, model.cuts), model.depth)


def probabilities(rows: DataFrame, models: list[Trees], keep: list[str]) -> DataFrame:
    """(keep, p_<class>...): the models' mean probabilities of each class."""
    features, classes = models[0].features, models[0].classes
    shared = rows.sparkSession.sparkContext.broadcast(models)  # rounds x classes trees of 2**(depth + 1) places: the settings bound it

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.mean([softmax(margins_of(m, b[features].to_numpy(float))) for m in shared.value], axis=0)
            yield b[keep].assign(**{f"p_{c}": p[:, i] for i, c in enumerate(classes)})

    chosen = rows.select(*keep, *(F.col(f).cast("double").alias(f) for f in features if f not in keep))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return chosen.mapInPandas(score, kept + "".join(f", `p_{c}` double" for c in classes))


def _leaves(tree):
    """(place, [(feature, bin, goes right, share of the cover)]) of each leaf."""
    feature, cut, _, cover = tree
    todo = [(0, [])]
    while todo:
        at, path = todo.pop()
        if feature[at] < 0:
            yield at, path
            continue
        for side in (0, 1):
            child = 2 * at + 1 + side
            share = cover[child] / cover[at] if cover[at] > 0 else 0.5
            todo.append((child, [*path, (int(feature[at]), int(cut[at]), side, share)]))


def tree_attributions(tree, x: np.ndarray, out: np.ndarray) -> None:
    """Add the exact path-dependent Shapley values of one tree to ``out`` (rows x features + 1, the last: the expected value).

    For each leaf the features on its path are put on one after another (``extend``): w[i] is the summed weight of the orders in which i of them
    are known. Each is then taken off again (``unwind``), and the rest's weight is what it decides.
    """
    n = len(x)
    for at, path in _leaves(tree):
        value, own = tree[2][at], {}
        for f, b, side, share in path:
            met, part = own.get(f, (np.ones(n, bool), 1.0))
            own[f] = met & ((x[:, f] > b) == bool(side)), part * share
        out[:, -1] += value * np.prod([part for _, part in own.values()])
        m = len(own)
        w = np.zeros((m + 1, n))
        w[0] = 1.0
        for d, (met, part) in enumerate(own.values(), 1):
            for i in range(d - 1, -1, -1):
                w[i + 1] += met * w[i] * (i + 1) / (d + 1)
                w[i] = part * w[i] * (d - i) / (d + 1)
        for f, (met, part) in own.items():
            total, after = np.zeros(n), w[m].copy()
            for i in range(m - 1, -1, -1):
                with_ = after * (m + 1) / (i + 1)
                without = w[i] * (m + 1) / (part * (m - i)) if part > 0 else np.zeros(n)
                total += np.where(met, with_, without)
                after = w[i] - with_ * part * (m - i) / (m + 1)
            out[:, f] += total * (met - part) * value


def attributions(model: Trees, x: np.ndarray) -> np.ndarray:
    """(rows, classes, features + 1): what each feature adds to each class's margin, and the expected margin; a row's sum is its margin."""
    b, out = binned(x, model.cuts), np.zeros((len(x), len(model.classes), len(model.features) + 1))
    for trees in model.rounds:
        for c, tree in enumerate(trees):
            tree_attributions(tree, b, out[:, c])
    return out


def explain(rows: DataFrame, models: list[Trees], keep: list[str]) -> DataFrame:
    """(keep, class, feature, contribution): the models' mean attributions; the expected margin under the name BIAS."""
    features, classes = models[0].features, models[0].classes
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = [*features, "BIAS"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                v = np.mean([attributions(m, part[features].to_numpy(float)) for m in shared.value], axis=0)
                index = part[keep].loc[part.index.repeat(len(classes) * len(names))].reset_index(drop=True)
                yield index.assign(**{"class": np.tile(np.repeat(classes, len(names)), len(part)), "feature": np.tile(names, len(part) * len(classes)), "contribution": v.reshape(-1)})

    chosen = rows.select(*keep, *(F.col(f).cast("double").alias(f) for f in features if f not in keep))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return chosen.mapInPandas(task, f"{kept}, `class` string, feature string, contribution double")

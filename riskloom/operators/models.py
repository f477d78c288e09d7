"""Models of host-days: isolation forests of the four domains and the seven-day forecast of fused scores.

What is fitted is small and bounded (a forest on ``SAMPLE`` rows, a ridge on sums of products); what is scored is every row,
in Arrow batches, each task with the whole model. Rows need no order and no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees of a forest, rows of a tree, rows at most that the trees draw from (those of smallest hash), seed of the draws.
TREES, ROWS, SAMPLE, SEED = 180, 512, 16_384, 20_261_021
#: Layers of the forecast, their hidden units, days of a window, weight of the ridge.
LAYERS, HIDDEN, DAYS, ALPHA = 3, 64, 7, 1000.0


def expected_depth(n: np.ndarray) -> np.ndarray:
    """How deep a search among ``n`` rows ends on average when it finds none."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 3.0)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as arrays of ``2 ** (depth + 1) - 1`` places: feature (-1: a leaf), cut, and the depth that ending there stands for."""
    size = 2 ** (depth + 1) - 1
    feature, cut, ends = np.full(size, -1), np.zeros(size), np.zeros(size)
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        place, level, rows = todo.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        varied = np.flatnonzero(high > low)
        if level == depth or len(rows) < 2 or not len(varied):
            ends[place] = level + expected_depth(len(rows))
            continue
        f = rng.choice(varied)
        feature[place], cut[place] = f, rng.uniform(low[f], high[f])
        left = x[rows, f] <= cut[place]
        todo += [(2 * place + 1, level + 1, rows[left]), (2 * place + 2, level + 1, rows[~left])]
    return feature, cut, ends


def forest(x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> dict:
    """A forest over the rows of ``x``, each tree over ``rows`` of them at most, drawn without repeats."""
    if not len(x):
        raise ValueError("no rows to fit a forest on")
    rng, n = np.random.default_rng(seed), min(rows, len(x))
    depth = int(np.ceil(np.log2(max(n, 2))))
    made = [grow(x[rng.choice(len(x), n, replace=False)], rng, depth) for _ in range(trees)]
    return {"trees": [np.stack(part) for part in zip(*made)], "depth": depth, "norm": float(max(expected_depth(n), 1e-9))}


def anomaly(model: dict, x: np.ndarray) -> np.ndarray:
    """The score of each row between 0 and 1; near 1 is what few cuts set apart."""
    feature, cut, ends = model["trees"]
    total = np.zeros(len(x))
    for f, c, e in zip(feature, cut, ends):
        at = np.zeros(len(x), dtype=int)
        for _ in range(model["depth"]):
            inner = f[at] >= 0
            right = x[np.arange(len(x)), np.maximum(f[at], 0)] > c[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        total += e[at]
    return 2.0 ** (-total / len(feature) / model["norm"])


def fit_forests(days: DataFrame, domains: dict[str, list[str]], key: list[str], trees: int = TREES) -> dict[str, dict | None]:
    """A forest for each domain over log1p of its features, from the ``SAMPLE`` rows whose keys have the smallest hashes. Null counts as 0. Without rows there is none."""
    names = sorted({f for fs in domains.values() for f in fs})
    rows = days.select(F.xxhash64(*key).alias("h"), *(F.log1p(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in names))
    sample = rows.orderBy("h", *names).limit(SAMPLE).toPandas()
    return {d: forest(sample[fs].to_numpy(float), trees) if len(sample) else None for d, fs in domains.items()}


def score_forests(days: DataFrame, models: dict[str, dict], domains: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """(keep, domains): the raw score of every row in each domain, null where there is no forest."""
    names = sorted({f for fs in domains.values() for f in fs})
    rows = days.select(*keep, *(F.log1p(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in names))
    shared = days.sparkSession.sparkContext.broadcast(models)  # TREES trees of 2 * ROWS places a domain: some MB, whatever the data

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keep].assign(**{d: anomaly(shared.value[d], b[fs].to_numpy(float)) if shared.value[d] else np.full(len(b), np.nan) for d, fs in domains.items()})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInPandas(score, kept + "".join(f", {d} double" for d in domains))


def upper_tenth(scores: DataFrame, own, domains: list[str]) -> DataFrame:
    """``scores`` with each domain's place among the upper tenth of the rows where ``own`` holds (0 below it, 1 at its top; null without a score), risk and peak.

    Scores count to six places, so there are at most a million different ones to rank, and the tail is held as 101 of them.
    """
    steps = [0.9 + i / 1000 for i in range(101)]
    held = scores.withColumns({d: F.round(d, 6) for d in domains})
    ref = held.where(own).agg(*(F.percentile(d, F.array(*map(F.lit, steps))).alias(f"q_{d}") for d in domains))
    at = lambda d: F.when(F.col(d).isNotNull(), F.coalesce(F.greatest(F.lit(0), F.size(F.filter(f"q_{d}", lambda q: q <= F.col(d))) - 1), F.lit(0)) / 100.0)
    out = held.join(F.broadcast(ref)).withColumns({d: at(d) for d in domains}).drop(*(f"q_{d}" for d in domains))  # one row
    return out.withColumns({"risk": sum((F.col(d) for d in domains), F.lit(0.0)) / len(domains), "peak": F.greatest(*domains)})


def layers(seed: int = SEED, hidden: int = HIDDEN, count: int = LAYERS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Weights that are never trained: of the input, of the state, and the bias of a layer's four gates."""
    out = []
    for i in range(count):
        rng, side = np.random.default_rng(seed + 100 * i), 1 / np.sqrt(hidden)
        width = 1 if i == 0 else 1 + hidden
        out.append(tuple(rng.uniform(-side, side, shape) for shape in ((width, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,))))
    return out


def hidden_states(history: np.ndarray, weights: list) -> list[np.ndarray]:
    """Each layer's last state over the windows ``history`` (rows, days), with the window itself before it; a layer sees the one before."""
    out, below = [], None
    squash = lambda v: 1 / (1 + np.exp(-v))
    for w_in, w_state, bias in weights:
        h = c = np.zeros((len(history), w_state.shape[0]))
        for day in range(history.shape[1]):
            x = history[:, day : day + 1]
            seen = x if below is None else np.hstack([x, below])
            i, f, g, o = np.split(seen @ w_in + h @ w_state + bias, 4, axis=1)
            c = squash(f) * c + squash(i) * np.tanh(g)
            h = squash(o) * np.tanh(c)
        out.append(np.hstack([history, h]))
        below = h
    return out


def fit_forecast(windows: DataFrame, target: str, alpha: float = ALPHA) -> list[tuple[np.ndarray, float]]:
    """A ridge for each layer, its mean free, from sums of products: what comes to the driver is as large for any number of rows. Without windows there is none."""
    weights, width = layers(), DAYS + HIDDEN + 2

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((LAYERS, width, width))
        for b in batches:
            history, y = np.array(b["history"].tolist(), dtype=float).reshape(-1, DAYS), b[target].to_numpy(float)
            for n, d in enumerate(hidden_states(history, weights)):
                row = np.hstack([np.ones((len(y), 1)), d, y[:, None]])
                total[n] += row.T @ row
        n, i, j = np.indices(total.shape).reshape(3, -1)
        yield pd.DataFrame({"n": n, "i": i, "j": j, "v": total.ravel()})

    parts = windows.select("history", target).mapInPandas(products, "n int, i int, j int, v double").groupBy("n", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((LAYERS, width, width))
    total[parts["n"], parts["i"], parts["j"]] = parts["v"]
    out = []
    for t in total if total[0, 0, 0] else ():
        n = t[0, 0]
        mean = t[0, 1:] / n
        spread = t[1:, 1:] - n * np.outer(mean, mean)
        slope = np.linalg.solve(spread[:-1, :-1] + alpha * np.eye(width - 2), spread[:-1, -1])
        out.append((slope, float(mean[-1] - mean[:-1] @ slope)))
    return out


def forecast(windows: DataFrame, model: list[tuple[np.ndarray, float]], keep: list[str]) -> DataFrame:
    """(keep, forecast): the median of the layers' forecasts of each window, null without a model."""
    if not model:
        return windows.select(*keep, F.lit(None).cast("double").alias("forecast"))
    weights = layers()

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            history = np.array(b["history"].tolist(), dtype=float).reshape(-1, DAYS)
            said = [d @ slope + base for d, (slope, base) in zip(hidden_states(history, weights), model)]
            yield b[keep].assign(forecast=np.median(said, axis=0))

    rows = windows.select(*keep, "history")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInPandas(predict, kept + ", forecast double")

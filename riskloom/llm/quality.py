"""Quality classifier by weak labels: overlapping heuristics vote, EM weighs them, a hashed linear model learns.

Eight labellers look at a whole text and vote good, junk or nothing. Expectation-maximisation
estimates from the counts of vote patterns (at most 3^8, whatever the input) how often each labeller
votes what for either class, and with that the posterior of every pattern. A logistic scorer over
hashed word shapes then learns the posteriors, so that documents on which the labellers are silent
are judged by what they look like. It is fitted on at most twice ``SAMPLE`` documents (about ``SAMPLE``), chosen by the
hash of doc_id and text, equal rows once; votes, patterns and scores cover all documents.

Null and empty texts have no votes and score as the prior: they are kept where most documents are good
(a prior of at least ``THRESHOLD``). Repeated rows give repeated results. An empty table gives an empty one. Other columns are kept by ``keep_good``. Equal votes and equal scores are no ties to break: each row is judged alone.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from riskloom.llm.shared import sheltered, slices, table, texts

LABELLERS = ("symbols", "capitals", "exclamation", "echo", "variety", "lines", "function_words", "long_words")
SAMPLE, DIMENSIONS, THRESHOLD = 8192, 4096, 0.5
#: Frequent words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the and of to in that is for on with a as it this by from or are at was der die das und ist ein zu den von mit "
    b"le la les de et un une est que dans qui pour el los las en por con para del no una".split()
)
_SYMBOL, _RUN = re.compile(rb"[#*$%&|<>]"), re.compile(rb"(.)\1+", re.S)
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 else 48 if 48 <= i <= 57 else 117 if i >= 128 else i for i in range(256))


class _Words(dict):
    """Word -> hashed shape, and its marks in higher bits; emptied when it has grown."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        shape = _RUN.sub(rb"\1", w.translate(_SHAPE))
        bits = xxh32_intdigest(shape) % DIMENSIONS
        bits |= bool(_SYMBOL.search(w)) << 16 | (w.isupper() and len(w) > 1) << 17 | (b"!" in w) << 18
        bits |= (w.lower().strip(b".,;:!?") in FUNCTION_WORDS) << 19 | (len(w) > 40) << 20
        self[w] = bits
        return bits


def _vote(x: float, junk: float, good: float, enough: bool = True) -> int:
    """2 junk, 1 good, 0 nothing; junk may lie above or below good."""
    if not enough:
        return 0
    if junk > good:
        return 2 if x > junk else 1 if x < good else 0
    return 2 if x < junk else 1 if x > good else 0


def look(text: bytes, cache: dict) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Votes of the labellers, and the hashed features of a text: indexes and values."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(LABELLERS), np.zeros(0, np.int64), np.zeros(0)
    codes = np.fromiter(map(cache.__getitem__, words), np.int64, n)
    share = [float(np.count_nonzero(codes & (1 << b))) / n for b in range(16, 21)]
    echo = sum(map(eq, words, words[1:])) / n
    variety = len(set(words)) / n
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 1 - len(set(lines)) / len(lines)
    votes = [
        _vote(share[0], 0.3, 0.05),
        _vote(share[1], 0.5, 0.1, n >= 5),
        _vote(share[2], 0.3, 0.05),
        _vote(echo, 0.2, 0.02, n >= 10),
        _vote(variety, 0.15, 0.35, n >= 50),
        _vote(repeated, 0.5, 0.3, len(lines) >= 4),
        _vote(share[3], 0.005, 0.05, n >= 40),
        2 if share[4] > 0.1 else 0,
    ]
    index, count = np.unique(codes & 0xFFFF, return_counts=True)
    scale = [f"{k}:{min(9, int(v * 10))}" for k, v in (("echo", echo), ("variety", variety if n >= 50 else 1), ("lines", repeated if len(lines) >= 4 else 0))]
    more = [xxh32_intdigest(s, 1) % DIMENSIONS for s in scale]
    return votes, np.concatenate([index, more]), np.concatenate([count / n, np.ones(len(more))])


def _votes(docs: DataFrame) -> DataFrame:
    def task(batches):
        cache = _Words()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, look(t, cache)[0])) for t in texts(b)], pa.string())], ["votes"])

    return docs.select(F.col("text").cast("string")).mapInArrow(task, "votes string")


def expectation_maximisation(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], float, np.ndarray]:
    """Posterior of good for each vote pattern, the prior, and P(vote | class) as [class, labeller, vote].

    Begins with the majority of votes; classes stay named, since every round starts from the last one's.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, 0.5, np.zeros((2, len(LABELLERS), 3))
    v = np.array([list(map(int, p)) for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    good = (v == 1).sum(1) - 1.5 * (v == 2).sum(1)
    q = 1 / (1 + np.exp(-good - 0.5))
    for _ in range(rounds):
        w = np.stack([n * (1 - q), n * q])
        prior = np.clip(w[1].sum() / n.sum(), 0.01, 0.99)
        chance = np.stack([[[w[c][v[:, j] == k].sum() + 1.0 for k in range(3)] for j in range(v.shape[1])] for c in (0, 1)])
        chance /= chance.sum(2, keepdims=True)
        logs = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(chance[:, j, v[:, j]]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return dict(zip(patterns, q.tolist())), float(prior), chance


def fit_linear(rows: list, posterior: dict[str, float], prior: float, rounds: int = 300) -> np.ndarray:
    """Weights and, last, the bias of a logistic model for soft labels; full-batch steps with Adagrad."""
    w = np.zeros(DIMENSIONS + 1)
    w[-1] = np.log(prior / (1 - prior))
    rows = [r for r in rows if len(r["index"])]
    if not rows:
        return w
    index = np.concatenate([np.frombuffer(r["index"], np.uint16) for r in rows]).astype(np.int64)
    value = np.concatenate([np.frombuffer(r["value"], np.float32) for r in rows]).astype(float)
    size = np.array([len(r["index"]) // 2 for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    label = np.array([posterior[r["votes"]] for r in rows])
    total = np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, w[index] * value, len(rows)) + w[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - label
        g = np.append(np.bincount(index, gap[row] * value, DIMENSIONS), gap.sum()) / len(rows) + 1e-6 * w
        total += g * g
        w -= 0.5 * g / np.sqrt(total)
    return w


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The labellers' accuracies from all documents and the scorer from a bounded sample of them."""
    counts = {r["votes"]: r["count"] for r in _votes(docs).groupBy("votes").count().collect()}  # at most 3^8 rows
    posterior, prior, chance = expectation_maximisation(counts)
    # of equal rows one is a candidate; hashes below 2^62 reach any number of documents
    mark = F.xxhash64(F.lit("fit"), F.col("doc_id").cast("string"), F.col("text").cast("string"))
    chosen = docs.select(F.col("text").cast("string").alias("text"), mark.alias("mark"))
    chosen = chosen.where(F.pmod("mark", F.lit(1 << 62)) < min(1 << 62, (sample << 62) // max(1, sum(counts.values()))))

    def task(batches):
        cache = _Words()
        for b in slices(batches):
            seen = [look(t, cache) for t in texts(b)]
            cols = [["".join(map(str, s[0])) for s in seen], [s[1].astype(np.uint16).tobytes() for s in seen], [s[2].astype(np.float32).tobytes() for s in seen]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), b.column("mark")], ["votes", "index", "value", "mark"])

    rows = chosen.mapInArrow(task, "votes string, index binary, value binary, mark long").dropDuplicates(["mark"]).orderBy(F.pmod("mark", F.lit(1 << 62)), "mark").limit(2 * sample).collect()
    return {"posterior": posterior, "prior": prior, "chance": chance, "weights": fit_linear(rows, posterior, prior)}


def score(docs: DataFrame, model: dict, names: tuple[str, str, str] = ("votes", "posterior", "score")) -> DataFrame:
    """The rows of ``docs`` with votes, posterior and score (both: of being good), under ``names`` that ``docs`` doesn't have."""
    weights, posterior, prior = model["weights"].astype(np.float32), model["posterior"], model["prior"]

    def task(batches):
        cache = _Words()
        for b in slices(batches):
            votes, post, scores = [], [], []
            for t in texts(b):
                v, index, value = look(t, cache)
                votes.append("".join(map(str, v)))
                post.append(posterior.get(votes[-1], prior))
                scores.append(float(1 / (1 + np.exp(-np.clip(weights[index] @ value + weights[-1], -50, 50)))) if len(index) else prior)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(votes, pa.string()), pa.array(post, pa.float64()), pa.array(scores, pa.float64())], [*b.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(task, f"{fields}, {names[0]} string, {names[1]} double, {names[2]} double")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, as they are, whatever their other columns are called."""
    rows = sheltered(docs, ("doc_id", "text"))
    return score(rows, fit(rows)).where(F.col("score") >= threshold).select(*rows.columns).toDF(*docs.columns)


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs))
    return out.select("doc_id", "votes", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), (F.col("score") >= THRESHOLD).alias("kept"))


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}

"""N-gram language model in an Elias-Fano trie.

Words are numbered by the rank of their 64-bit hash in the vocabulary of all training texts. The trie's
second level holds the pairs, the third the triples of words. A level is one ascending sequence, the
number of the context times the size of the vocabulary plus the last word, so its high part is the
monotone pointer from each entry to its context. It is kept in Elias-Fano form: the low bits packed,
the high bits as a unary bit vector with counts for select. A query is a successor search relative to
its context: the high part picks a bucket, the low bits are searched inside it. Beside each entry are
one-byte codes: of its share of its context's count, and, for a pair, of the weight of the order below.

Probabilities are interpolated: p(w | u v) = c(u v w) / (c(u v) + M) + M / (c(u v) + M) * p(w | v), in
the same way down to p(w) = (c(w) + 1) / (N + V + 1), which leaves 1 / (N + V + 1) for words not seen.

Texts are lower-cased (A-Z), cut at blanks and end with one end mark that counts as a token. The trie
is split by the hash of pairs into files of about ``SHARD`` bytes of training text (no fewer than the
session has shuffle partitions); a context's triples are in the file of its pair, and a task makes a file. Files lie in the shared folder and are memory-mapped by the tasks
that score. Counts travel packed and summed up, so a frequent pair costs one entry a task and flush.

Null and empty texts are the end mark alone. A null doc_id is trained on. Repeated rows count each.
Without training texts all probabilities are 1. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskloom.llm.shared import by_shard, map_arrays, mix, new_folder, pack, shard_of, shards_for, starts_of, table, texts, unpack, write_arrays

END = b""  # no word is empty
FLUSH, WEIGHT2, WEIGHT3 = 1 << 20, 8.0, 4.0
STEP = 0.04  # of log10 for each code
ONE = np.uint64(1)
#: Bytes of text to a shard; entries that a shard holds before it adds up equal ones; words of a block that fit three to a number.
SHARD, HELD, LOCAL = 24 << 20, 4 << 20, 1 << 21


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]  # on bytes: A-Z only, and exactly \x20 and \x09-\x0D


# -- Elias-Fano ------------------------------------------------------------------------------------


def elias_fano(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    """Ascending distinct values below ``universe`` as packed low bits and unary high bits."""
    n = len(values)
    low = max(0, (universe // max(1, n)).bit_length() - 1)
    buckets = (universe >> low) + 1
    bits = np.zeros((n + buckets + 64) // 64 * 64, np.uint8)
    bits[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
    packed = []
    for i in range(0, n, 1 << 18):  # so many values at a time; a multiple of 64 keeps parts whole words
        v = values[i : i + (1 << 18)]
        packed.append(np.packbits(((v[:, None] >> np.arange(low, dtype=np.uint64)) & ONE).astype(np.uint8).reshape(-1), bitorder="little"))
    raw = np.concatenate([*packed, np.zeros(16, np.uint8)])
    lows = np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view("<u8")
    return {f"{name}.meta": np.array([n, low, buckets], np.uint64), f"{name}.low": lows, f"{name}.high": words, f"{name}.zeros": zeros.astype(np.uint64)}


def _low(lows: np.ndarray, low: int, at: np.ndarray) -> np.ndarray:
    """The low bits of the entries ``at``."""
    if not low:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(low)
    word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    over = np.where(off > 0, lows[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
    return ((lows[word] >> off) | over) & np.uint64((1 << low) - 1)


def _select_zero(words: np.ndarray, zeros: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th zero (from 0) of the bit vector."""
    word = np.searchsorted(zeros, k, side="right") - 1
    rest = k - zeros[word]
    left = ~words[word]
    at = np.zeros(len(k), np.uint64)
    for half in (32, 16, 8, 4, 2, 1):
        inside = np.bitwise_count(left & np.uint64((1 << half) - 1)).astype(np.uint64)
        on = rest >= inside
        rest = rest - np.where(on, inside, np.uint64(0))
        step = np.where(on, np.uint64(half), np.uint64(0))
        left = left >> step
        at += step
    return word.astype(np.uint64) * np.uint64(64) + at


def successor(level: dict[str, np.ndarray], name: str, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the number of the first entry not below it, and whether it is equal."""
    n, low, buckets = (int(x) for x in level[f"{name}.meta"])
    at, found = np.full(len(values), n, np.int64), np.zeros(len(values), bool)
    lows, words, zeros = level[f"{name}.low"], level[f"{name}.high"], level[f"{name}.zeros"]
    mask = np.uint64((1 << low) - 1)
    for i in range(0, len(values), 1 << 14):
        v = values[i : i + (1 << 14)]
        high = v >> np.uint64(low)
        stop = _select_zero(words, zeros, high) - high
        begin = np.where(high > 0, _select_zero(words, zeros, np.maximum(high, ONE) - ONE) - (np.maximum(high, ONE) - ONE), np.uint64(0))
        lo, hi, want = begin.astype(np.int64), stop.astype(np.int64), v & mask
        end = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = _low(lows, low, mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        here = lo < end
        hit = np.zeros(len(v), bool)
        hit[here] = _low(lows, low, lo[here]) == want[here]
        at[i : i + len(v)], found[i : i + len(v)] = lo, hit
    return at, found


def codes(share: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(share) / STEP), 0, 255).astype(np.uint8)


VALUE = 10.0 ** (-STEP * np.arange(256))


# -- counting --------------------------------------------------------------------------------------


class _Local(dict):
    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def _flushes(batches, size: int = FLUSH):
    """(columns besides the text, token numbers of each text, the block's words) for blocks of about ``size`` tokens."""
    rest, parts, local, held = [], [], _Local(), 0
    for b in batches:
        others = list(zip(*(b.column(i).to_pylist() for i in range(b.num_columns) if b.schema.names[i] != "text"))) or [()] * b.num_rows
        for other, text in zip(others, texts(b)):
            words = tokens(text)
            rest.append(other)
            parts.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
            held += len(words)
            if held >= size:
                yield rest, parts, local
                rest, parts, local, held = [], [], _Local(), 0
    if rest:
        yield rest, parts, local


def _hashes(local: dict) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, local), np.uint64, len(local))


def _batch(rows: list, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


_ROW = [("shard", pa.int32()), ("data", pa.binary())]


def triples_of(seq: np.ndarray, real: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of three numbers below ``size`` in ``seq`` in ascending order, and how often each stands at a ``real`` place."""
    size = np.uint64(size)
    if size <= LOCAL:
        key, count = np.unique(((seq[:-2] * size + seq[1:-1]) * size + seq[2:])[real], return_counts=True)
        pair, last = key // size, key % size
    else:  # the block of a text with more words than fit: the pairs are numbered first
        pairs, place = np.unique((seq[:-2] * size + seq[1:-1])[real], return_inverse=True)
        key, count = np.unique(place.astype(np.uint64) * size + seq[2:][real], return_counts=True)
        pair, last = pairs[(key // size).astype(np.int64)], key % size
    return pair // size, pair % size, last, count


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Columns of keys (the first is the highest) and, last, counts: ascending, equal keys added up."""
    *keys, count = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort(keys[::-1])
    keys, count = [k[order] for k in keys], count[order]
    new = np.zeros(len(count), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return (*(k[at] for k in keys), np.add.reduceat(count, at) if len(at) else count)


def _gathered(batches, read) -> tuple[np.ndarray, ...]:
    """All that the packed rows of a shard hold, added up whenever much has come in."""
    parts, held = [], 0
    for b in batches:
        for data in b.column("data").to_pylist():
            parts.append(read(_split(data)))
            held += len(parts[-1][0])
            if held > 2 * HELD:
                parts = [summed(parts)]
                held = max(len(parts[0][0]), HELD)
    return summed(parts)


def train(docs: DataFrame) -> dict:
    """Write the model of ``docs(text)`` to the shared folder; what is returned is its place and a few totals."""
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string"))
    n, folder = shards_for(rows, SHARD), new_folder(spark, "trie")

    def words(batches):
        for _, parts, local in _flushes(batches):
            keys, count = _hashes(local), np.bincount(np.concatenate(parts), minlength=len(local))
            order = np.argsort(keys)
            keys, count = keys[order], count[order]
            cuts = np.searchsorted(shard_of(keys, n), np.arange(n + 1))
            yield _batch([(s, _join([pack(keys[cuts[s] : cuts[s + 1]], True), pack(count[cuts[s] : cuts[s + 1]])])) for s in np.flatnonzero(np.diff(cuts)).tolist()], _ROW)

    def vocabulary(s, batches):
        keys, count = _gathered(batches, lambda p: (unpack(p[0], True), unpack(p[1]).astype(np.int64)))
        write_arrays(f"{folder}/words-{s:05d}", {"keys": keys, "counts": count.astype(np.uint32 if count.max() < 1 << 32 else np.int64)})
        yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(count.sum())], pa.int64())})

    made = by_shard(rows.mapInArrow(words, "shard int, data binary"), n, vocabulary, "shard int, n long, total long").collect()  # a row a shard
    sizes = np.zeros(n + 1, np.int64)
    for r in made:
        sizes[r["shard"] + 1] = r["n"]
    model = {"folder": folder, "shards": n, "offsets": np.cumsum(sizes), "tokens": sum(r["total"] for r in made), "trie": frozenset()}
    distinct = model["distinct"] = int(sizes.sum())
    if not distinct:
        return model
    if (distinct + 3) ** 2 >= 1 << 64:
        raise ValueError("more words than pairs of them have numbers")
    universe, first, last = np.uint64(distinct + 2), distinct, distinct + 1  # words, start mark, mark after the end

    def triples(batches):
        for _, parts, local in _flushes(batches):
            number, _ = _numbers(model, _hashes(local))
            both = np.concatenate([number, [first, last]])
            order = np.argsort(both)  # local numbers in the order of the global ones, so sorted triples stay sorted
            rank = np.empty(len(both), np.int64)
            rank[order] = np.arange(len(both))
            both = both[order].astype(np.uint64)
            start, after = rank[-2], rank[-1]
            seq = np.concatenate([np.concatenate([[start, start], rank[p], [after]]) for p in parts]).astype(np.uint64)
            ends = np.cumsum([len(p) + 3 for p in parts])
            real = np.ones(len(seq) - 2, bool)
            for back in (1, 2):
                real[ends[:-1] - back] = False
            a, b, c, count = triples_of(seq, real, len(both))
            pair, word = both[a.astype(np.int64)] * universe + both[b.astype(np.int64)], both[c.astype(np.int64)]
            shard = shard_of(mix(pair), n).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(n + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[s] : cuts[s + 1]]
                out.append((s, _join([pack(pair[at], True), pack(word[at]), pack(count[at])])))
            yield _batch(out, _ROW)

    def trie(s, batches):
        pair, word, count = _gathered(batches, lambda p: (unpack(p[0], True), unpack(p[1]), unpack(p[2]).astype(np.int64)))
        of = starts_of(pair)
        number = np.repeat(np.arange(len(of)), np.diff(np.append(of, len(pair))))
        total = np.add.reduceat(count, of)  # of a pair: the times it is followed by anything, so all its times
        context = (pair[of] // universe).astype(np.int64)
        before = _counts(model, context)
        share2 = np.minimum(total / (before + WEIGHT2), 1.0)
        arrays = elias_fano(pair[of], int(universe) ** 2, "two") | elias_fano(number.astype(np.uint64) * universe + word, len(of) * int(universe), "three")
        arrays |= {"share2": codes(share2), "weight3": codes(WEIGHT3 / (total + WEIGHT3)), "share3": codes(count / (total[number] + WEIGHT3))}
        write_arrays(f"{folder}/trie-{s:05d}", arrays)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "n": pa.array([len(word)], pa.int64())})

    made = by_shard(rows.mapInArrow(triples, "shard int, data binary"), n, trie, "shard int, n long").collect()  # a row a shard
    return model | {"trie": frozenset(r["shard"] for r in made)}


# -- scoring ---------------------------------------------------------------------------------------


def _numbers(model: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and count of each word by its hash; -1 and 0 where the vocabulary doesn't have it."""
    n, number, count = model["shards"], np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    order = np.argsort(keys)
    cuts = np.searchsorted(shard_of(keys[order], n), np.arange(n + 1))
    for s in range(n):
        at = order[cuts[s] : cuts[s + 1]]
        if not len(at) or model["offsets"][s + 1] == model["offsets"][s]:
            continue
        held = map_arrays(f"{model['folder']}/words-{s:05d}")
        place = np.minimum(np.searchsorted(held["keys"], keys[at]), len(held["keys"]) - 1)
        hit = held["keys"][place] == keys[at]
        number[at[hit]] = model["offsets"][s] + place[hit]
        count[at[hit]] = held["counts"][place[hit]]
    return number, count


def _counts(model: dict, numbers: np.ndarray) -> np.ndarray:
    """How often each word (by number) stands before another token; the start mark: once a text."""
    unique, inverse = np.unique(numbers, return_inverse=True)
    out = np.zeros(len(unique))
    shard = np.searchsorted(model["offsets"], unique, side="right") - 1
    words = unique < model["distinct"]
    for s in np.unique(shard[words]):
        own = words & (shard == s)
        out[own] = map_arrays(f"{model['folder']}/words-{s:05d}")["counts"][unique[own] - model["offsets"][s]]
    out[unique == model["distinct"]] = _numbers(model, np.array([xxh64_intdigest(END)], np.uint64))[1][0]
    return out[inverse]


def log10_probabilities(model: dict, parts: list[np.ndarray], number: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 p of every token of the texts ``parts`` (numbers into number and count), end marks included."""
    universe, n = np.uint64(model["distinct"] + 2), model["shards"]
    start = len(number)
    number = np.append(np.where(number < 0, model["distinct"] + 1, number), model["distinct"]).astype(np.uint64)  # unknown: a mark that no pair has here
    sizes = np.array([len(p) for p in parts])
    flat = np.concatenate(parts)
    begins = np.cumsum(sizes) - sizes
    one = np.concatenate([[start], flat[:-1]])
    one[begins] = start
    texts_docs = _numbers(model, np.array([xxh64_intdigest(END)], np.uint64))[1][0]
    p = (count[flat] + 1) / (model["tokens"] + model["distinct"] + 1)
    before = np.append(count, texts_docs)[one]
    # pairs (b, c): share of b's count, number inside the shard, weight that the triples after it leave
    pair = number[one] * universe + number[flat]
    unique, inverse = np.unique(pair, return_inverse=True)
    shard = shard_of(mix(unique), n).astype(np.int64)
    share, weight, place = np.zeros(len(unique)), np.ones(len(unique)), np.full(len(unique), -1, np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        if s not in model["trie"]:
            continue
        own = order[cuts[s] : cuts[s + 1]]
        level = map_arrays(f"{model['folder']}/trie-{s:05d}")
        at, hit = successor(level, "two", unique[own])
        place[own[hit]] = at[hit]
        share[own[hit]], weight[own[hit]] = VALUE[level["share2"][at[hit]]], VALUE[level["weight3"][at[hit]]]
    p = share[inverse] + WEIGHT2 / (before + WEIGHT2) * p
    # triples (a, b, c): the context is the pair one place earlier, or two start marks
    opening = np.array([model["distinct"]], np.uint64) * universe + np.uint64(model["distinct"])
    head_shard = int(shard_of(mix(opening), n)[0])
    head_place, head_weight = -1, 1.0
    if head_shard in model["trie"]:
        level = map_arrays(f"{model['folder']}/trie-{head_shard:05d}")
        at, hit = successor(level, "two", opening)
        if hit[0]:
            head_place, head_weight = int(at[0]), float(VALUE[level["weight3"][at[0]]])

    def earlier(values, head):
        out = np.concatenate([[head], values[inverse][:-1]])
        out[begins] = head
        return out

    c_place, c_shard, c_weight = earlier(place, head_place), earlier(shard, head_shard), earlier(weight, head_weight)
    share3 = np.zeros(len(flat))
    known = np.flatnonzero(c_place >= 0)
    known = known[np.argsort(c_shard[known], kind="stable")]
    cuts = np.searchsorted(c_shard[known], np.arange(n + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = known[cuts[s] : cuts[s + 1]]
        level = map_arrays(f"{model['folder']}/trie-{s:05d}")
        key, back = np.unique(c_place[own].astype(np.uint64) * universe + number[flat[own]], return_inverse=True)
        at, hit = successor(level, "three", key)
        value = np.zeros(len(key))
        value[hit] = VALUE[level["share3"][at[hit]]]
        share3[own] = value[back]
    return np.log10(np.minimum(share3 + c_weight * p, 1.0))


SCORED = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of ``docs(doc_id, held_out, text)``; no shuffle."""

    def task(batches):
        for rest, parts, local in _flushes(batches):
            number, count = _numbers(model, _hashes(local))
            base = np.log10((count + 1) / (model["tokens"] + model["distinct"] + 1))
            value = log10_probabilities(model, parts, number, count) if model["distinct"] else np.zeros(sum(map(len, parts)))
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            begins = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, begins) for x in (base[flat], value, (count > 0)[flat].astype(np.int64))]
            yield _batch([(*r, int(z), int(k), model["tokens"], float(a), float(b)) for r, z, a, b, k in zip(rest, sizes, *sums)], SCORED)

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(task, kinds)


def op6_ngram_trie(spark, sf_dir):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return score(docs, train(docs.where(~F.col("held_out"))))


QUERIES = {"op6_ngram_trie": op6_ngram_trie}
SQL: dict[str, str] = {}

"""Quality rules and n-gram perplexity: a modified Kneser-Ney model of characters, bands for each language.

Tasks count the character 4-grams of their texts (words with one blank between, three start marks in
front), Spark adds the counts up and derives the lower orders, whose counts are the numbers of
distinct characters in front, the three discounts of each order and language, and the interpolated
probability of every n-gram. The model is written to the shared folder as sorted arrays of 64-bit
hashes with a value each, in ranges of the hash, and memory-mapped by the scoring tasks.

A document is rejected where its log-perplexity for a character or for a word lies outside the band of
its language: the median of the language, less or plus ``WIDTH`` times the spread of its middle half
(as standard deviations). Bands come from all documents that pass the base rules, by exact counts of
bits to three digits. A language whose documents are all alike has a band of at least ``FLOOR`` bits.

Null and empty texts have no words and fail the base rule. A null language is the language ''.
Repeated rows count each. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskloom.llm.shared import by_shard, map_arrays, materialize, mix, new_folder, shard_of, shards, starts_of, table, texts, write_arrays

ORDER, START, FLUSH = 4, 2, 1 << 21
WIDTH, FLOOR = 5.0, 0.05
#: Characters with a code in a task at a time, runs that it keeps, languages that it keeps, and languages whose figures are broadcast.
CODES, ROOM, LANGUAGES, FEW = 65_000, 3_000_000, 16, 100_000
SHARD = 1_000_000  # 4-grams to a file of the model
UNSEEN = 1 / 4096  # share of a character that the corpus doesn't have, at order 0


def stream(text: bytes) -> tuple[np.ndarray, int]:
    """Code points of the words with blanks between and after, start marks in front; and the number of words."""
    words = text.split()  # on bytes: exactly \x20 and \x09-\x0D
    line = b" ".join(words).decode("utf-8", "replace") + " " if words else ""
    return np.concatenate([np.full(ORDER - 1, START, np.uint32), np.frombuffer(line.encode("utf-32-le"), np.uint32)]), len(words)


def hashes(chars: np.ndarray, n: int, lang) -> np.ndarray:
    """A key for each run of n code points and its language (one hash, or one for each place where a run ends)."""
    with np.errstate(over="ignore"):
        key = np.zeros(max(0, len(chars) - n + 1), np.uint64)
        for j in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + chars[j : len(chars) - n + 1 + j]
        return mix(key + np.uint64(0xD6E8FEB86659FD93) * np.uint64(n) + lang)


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxh64_intdigest(lang, 7))


class _Counts:
    """4-gram counts of one language in one task: characters as 16-bit codes, runs as 64-bit numbers.

    ``fold`` and ``rows`` yield (grams, counts) that must go out: where codes or room are used up, both begin anew.
    """

    def __init__(self):
        self.code, self.held, self.size = np.zeros(0x110000, np.uint16), [], 0
        self._empty()

    def _empty(self):
        self.code[:] = 0
        self.char, self.keys, self.counts = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, chars: np.ndarray) -> bool:
        self.held.append(chars)
        self.size += len(chars)
        return self.size >= FLUSH

    def fold(self):
        got, self.held, self.size = self.held, [], 0
        if got and not self._count(got):
            for chars in got:  # pieces too short to have more characters than there are codes, each with the start of the next
                for i in range(0, len(chars) - ORDER + 1, CODES - ORDER):
                    piece = [chars[i : i + CODES - 1]]
                    if not self._count(piece):
                        yield self.rows()
                        self._empty()
                        self._count(piece)
        if len(self.keys) > ROOM:
            yield self.rows()
            self._empty()

    def _count(self, got: list[np.ndarray]) -> bool:
        """Count the runs of ``got``; False, and nothing is counted, if their characters need more codes than are left."""
        every = np.concatenate(got)
        there = np.zeros(0x110000, bool)
        there[every] = True
        new = np.flatnonzero(there & (self.code == 0))
        if len(self.char) + len(new) > CODES:
            return False
        self.code[new] = np.arange(len(self.char) + 1, len(self.char) + len(new) + 1)
        self.char.extend(new.tolist())
        c = self.code[every].astype(np.uint64)
        key = (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]
        real = np.ones(len(key), bool)  # no run reaches from one document into the next
        ends = np.cumsum([len(g) for g in got])[:-1]
        for back in range(1, ORDER):
            real[ends - back] = False
        u, n = np.unique(key[real], return_counts=True)
        keys, counts = np.concatenate([self.keys, u]), np.concatenate([self.counts, n])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = starts_of(keys)
        self.keys, self.counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        return True

    def rows(self):
        char = np.zeros(CODES + 1, np.uint32)
        char[1 : len(self.char) + 1] = self.char
        codes = np.stack([(self.keys >> np.uint64(s)) & np.uint64(0xFFFF) for s in (48, 32, 16, 0)], 1).astype(np.int64)
        text = char[codes].astype("<u4").tobytes().decode("utf-32-le", "replace")
        return [text[i : i + ORDER] for i in range(0, len(text), ORDER)], self.counts


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all texts: summed up in each task, then by Spark. A task keeps the counts of few languages at a time."""

    def task(batches):
        kinds: dict[str, _Counts] = {}

        def out(lang, made):
            for grams, counts in made:
                for i in range(0, len(grams), 100_000):
                    part = grams[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(counts[i : i + 100_000], pa.int64())], ["lang", "gram", "n"])

        def end():
            for lang, one in kinds.items():
                yield from out(lang, one.fold())
                yield from out(lang, [one.rows()])
            kinds.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), texts(b)):
                if lang not in kinds and len(kinds) >= LANGUAGES:
                    yield from end()
                one = kinds.setdefault(lang, _Counts())
                if one.add(stream(text)[0]):
                    yield from out(lang, one.fold())
        yield from end()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string"))
    return rows.mapInArrow(task, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _bounded(df: DataFrame, languages: int) -> DataFrame:
    """A table with a row for each language: broadcast up to ``FEW`` of them, joined by a shuffle beyond."""
    return F.broadcast(df) if languages <= FEW else df


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, gram, kind, value): kind 'p' has log2 of a probability, 'b' log2 of the weight of the order below.

    Interpolated modified Kneser-Ney: three discounts for each order and language from the numbers of
    n-grams with counts 1 to 4; the lowest order is interpolated with ``UNSEEN``.
    """
    counts, languages = {ORDER: grams}, grams.select("lang").distinct().count()
    for n in range(ORDER - 1, 0, -1):
        counts[n] = counts[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
    lower, out = None, []
    for n in range(1, ORDER + 1):
        g = counts[n].withColumn("context", F.substring("gram", 1, n - 1))
        of = [F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(k, y):
            d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            return F.greatest(F.lit(0.1), F.least(F.coalesce(d, F.lit(k - 0.5)), F.lit(k - 0.05))).alias(f"d{k}")

        d = _bounded(g.groupBy("lang").agg(*of).withColumn("n1", F.greatest("n1", F.lit(1.0))).select("lang", *(discount(k, y) for k in (1, 2, 3))), languages)
        g = g.join(d, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        sums = g.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("kept_back"))
        g = g.join(sums, ["lang", "context"])
        weight = F.col("kept_back") / F.col("total")
        if lower is None:
            below = g.withColumn("q", F.lit(UNSEEN))
        else:
            below = g.join(lower, (g["lang"] == lower["l"]) & (F.substring(g["gram"], 2, n - 1) == lower["s"])).drop("l", "s")
        p = materialize(below.select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + weight * F.col("q")).alias("p")), f"grams{n}")
        out.append(p.select("lang", "gram", F.lit("p").alias("kind"), F.log2("p").alias("value")))
        out.append(sums.select("lang", F.col("context").alias("gram"), F.lit("b").alias("kind"), F.log2(weight).alias("value")))
        lower = p.select(F.col("lang").alias("l"), F.col("gram").alias("s"), F.col("p").alias("q"))
    model = out[0]
    for part in out[1:]:
        model = model.unionByName(part)
    return model


def write_model(model: DataFrame, folder: str, n: int | None = None) -> tuple[str, int, frozenset]:
    """Sorted hash arrays in the shared folder, a file for each range of hashes."""
    n = n or shards(model.sparkSession)

    def keyed(batches):
        for b in batches:
            langs, grams, kinds = (b.column(c).to_pylist() for c in ("lang", "gram", "kind"))
            seed = {x: lang_hash(x) for x in set(langs)}
            keys = np.zeros(len(grams), np.uint64)
            sizes = np.array([len(g) for g in grams])
            for size in set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                chars = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), size)
                with np.errstate(over="ignore"):
                    own = np.array([seed[langs[i]] for i in at], np.uint64) + np.array([1 << 40 if kinds[i] == "b" else 0 for i in at], np.uint64)
                    key = np.zeros(len(at), np.uint64)
                    for j in range(size):
                        key = key * np.uint64(0x9E3779B97F4A7C15) + chars[:, j]
                    keys[at] = mix(key + np.uint64(0xD6E8FEB86659FD93) * np.uint64(size) + own)
            cols = [pa.array(shard_of(keys, n).astype(np.int32)), pa.array(keys.view(np.int64)), b.column("value")]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "key", "value"])

    def write(shard, batches):
        parts = [(b.column("key").to_numpy(), b.column("value").to_numpy()) for b in batches]
        keys, values = np.concatenate([p[0] for p in parts]).view(np.uint64), np.concatenate([p[1] for p in parts]).astype(np.float32)
        order = np.argsort(keys)
        write_arrays(f"{folder}/{shard:05d}.grams", {"keys": keys[order], "values": values[order]})
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    found = by_shard(model.mapInArrow(keyed, "shard int, key long, value double"), n, write, "shard int, n long")
    there = {r["shard"] for r in found.collect()}  # a row for each shard
    return folder, n, frozenset(there)


def lookup(model, keys: np.ndarray) -> np.ndarray:
    """The value of each of the ascending keys, NaN where the model has none."""
    folder, n, there = model
    out = np.full(len(keys), np.nan)
    cuts = np.searchsorted(shard_of(keys, n), np.arange(n + 1))
    for s in range(n):
        part = keys[cuts[s] : cuts[s + 1]]
        if not len(part) or s not in there:
            continue
        held = map_arrays(f"{folder}/{s:05d}.grams")
        at = np.minimum(np.searchsorted(held["keys"], part), len(held["keys"]) - 1)
        hit = held["keys"][at] == part
        out[cuts[s] : cuts[s + 1]][hit] = held["values"][at[hit]]
    return out


def log_probability(model, runs: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """log2 p of the last of each row of ``runs`` (code points) after the others, backing off where it was not seen."""
    out, weight, open_ = np.zeros(len(runs)), np.zeros(len(runs)), np.arange(len(runs))
    for n in range(ORDER, 0, -1):
        value = _find(model, runs[open_, ORDER - n :], langs[open_])
        seen = ~np.isnan(value)
        out[open_[seen]] = weight[open_[seen]] + value[seen]
        open_ = open_[~seen]
        if not len(open_):
            return out
        with np.errstate(over="ignore"):
            back = _find(model, runs[open_, ORDER - n : ORDER - 1], langs[open_] + np.uint64(1 << 40))
        weight[open_] += np.nan_to_num(back)
    out[open_] = weight[open_] + np.log2(UNSEEN)
    return out


def _find(model, runs: np.ndarray, langs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.zeros(len(runs), np.uint64)
        for j in range(runs.shape[1]):
            key = key * np.uint64(0x9E3779B97F4A7C15) + runs[:, j]
        key = mix(key + np.uint64(0xD6E8FEB86659FD93) * np.uint64(runs.shape[1]) + langs)
    order = np.argsort(key)
    out = np.empty(len(key))
    out[order] = lookup(model, key[order])
    return out


class _Scorer:
    """Scores runs through a small direct-mapped table of keys met before; the model answers the rest."""

    def __init__(self, model, bits: int = 20):
        self.model, self.shift = model, np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)

    def bits(self, streams: list[np.ndarray], langs: list[str]) -> np.ndarray:
        """Minus log2 of the probability of each stream."""
        chars = np.concatenate(streams)
        sizes = np.array([len(s) for s in streams])
        lang = np.repeat(np.array([lang_hash(x) for x in langs], np.uint64), sizes)[ORDER - 1 :]
        key = hashes(chars, ORDER, lang)
        slot = (key >> self.shift).astype(np.int64)
        value = self.values[slot].astype(np.float64)
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            _, first, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            places = miss[first]
            found = log_probability(self.model, np.stack([chars[places + j] for j in range(ORDER)], 1), lang[places])
            value[miss] = found[inverse]
            self.values[slot[places]] = found
            self.keys[slot[places]] = key[places]  # of keys that share a slot the last stays, in both arrays
        sums = np.concatenate([[0.0], np.cumsum(value)])
        ends = np.cumsum(sizes) - (ORDER - 1)  # runs that end in this stream; those across a border lie between
        return -(sums[ends] - sums[ends - (sizes - (ORDER - 1))])


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n, joined = len(words), b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        k = len(ids)
        if k < 1 << 21:
            window = (a[:-2] * k + a[1:-1]) * k + a[2:]
        else:
            pair = np.unique(a[:-1] * k + a[1:], return_inverse=True)[1]
            window = pair[:-1] * k + a[2:]
        _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[j : n - 2 + j] |= twice
        repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


FACTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_bits double, word_bits double"


def score(docs: DataFrame, model) -> DataFrame:
    """The base counts and the bits for a character and for a word of each document; null without words."""

    def task(batches):
        scorer = _Scorer(model)
        names = [f.split()[0] for f in FACTS.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.float64()]

        def out(rows, streams):
            bits = scorer.bits(streams, [r[1] for r in rows])
            rows = [(*r, float(x) / max(1, len(s) - ORDER + 1) if r[2] else None, float(x) / r[2] if r[2] else None) for r, s, x in zip(rows, streams, bits)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        rows, streams, size = [], [], 0
        for b in batches:
            for doc, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), texts(b)):
                counts = base(text)
                n, repeat = counts[0], counts[4]
                rows.append((doc, lang, *counts, n < 50 or 100 * repeat > 50 * n))
                streams.append(stream(text)[0])
                size += len(streams[-1])
                if size >= FLUSH // 2:
                    yield out(rows, streams)
                    rows, streams, size = [], [], 0
        if rows:
            yield out(rows, streams)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string"))
    return rows.mapInArrow(task, FACTS)


def bands(facts: DataFrame, width: float = WIDTH, floor: float = FLOOR) -> DataFrame:
    """(lang, char_low, char_high, word_low, word_high): a row for each language."""
    sides = []
    for name in ("char", "word"):
        bits = F.greatest(F.col(f"{name}_bits"), F.lit(0.001))
        unit = F.pow(F.lit(10.0), F.floor(F.log10(bits)) - 2)  # three digits: at most 900 bins to a power of ten, however many documents
        binned = facts.where(f"{name}_bits is not null and not base_failed").groupBy("lang", F.round(F.round(bits / unit) * unit, 6).alias("bin")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("lang")
        ranked = binned.select("lang", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))

        def at(part):
            return F.min(F.when(F.col("upto") >= F.col("all") * part, F.col("bin")))

        q = ranked.groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
        half = F.greatest((F.col("q3") - F.col("q1")) / 1.349 * width, F.lit(floor))
        sides.append(q.select("lang", (F.col("q2") - half).alias(f"{name}_low"), (F.col("q2") + half).alias(f"{name}_high")))
    return sides[0].join(sides[1], "lang")


def judge(docs: DataFrame) -> DataFrame:
    """The facts of each document with ``kept``."""
    spark = docs.sparkSession
    grams = materialize(count_grams(docs), "grams")
    parts = max(shards(spark), grams.count() // SHARD)
    model = write_model(kneser_ney(grams), new_folder(spark, "kneser-ney"), parts)
    facts = materialize(score(docs, model), "facts")
    limits = materialize(bands(facts).select(F.col("lang").alias("of"), "char_low", "char_high", "word_low", "word_high"), "bands")
    met = facts.join(_bounded(limits, limits.count()), F.col("lang") == F.col("of"), "left")
    inside = F.col("char_bits").between(F.col("char_low"), F.col("char_high")) & F.col("word_bits").between(F.col("word_low"), F.col("word_high"))
    return met.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op7_perplexity(spark, sf_dir):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents")).select(*names, F.round("char_bits", 6).alias("char_bits"), F.round("word_bits", 6).alias("word_bits"))


QUERIES = {"op7_perplexity": op7_perplexity}
SQL: dict[str, str] = {}
__all__ = ["bands", "base", "count_grams", "judge", "kneser_ney", "score", "stream", "write_model"]

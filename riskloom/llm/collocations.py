"""Phrases that belong together: exact counts of word n-grams, cohesion by the weakest cut, the best of each language.

Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, A-Z lower-cased, pieces into words ``[^\\x20\\x09]+``.

1. **Pieces once.** A task puts the distinct pieces of some MB of text, with their multiplicities, into packets by hash;
   the bucket of a hash range adds the multiplicities up, so a sentence of a million copies is cut into n-grams once.
2. **Weighted n-grams, out of core.** The bucket counts n-grams of its pieces, weighted by multiplicity, in DuckDB,
   which spills to a folder of the shared store where that is mounted; the counts go to buckets by hash of the n-gram, where DuckDB
   adds them up and keeps those with ``least`` or more. Every part of a candidate is at least as frequent as the candidate, so nothing
   that is asked for later is lost.
3. **Lookups.** Candidates send requests for the counts of both parts of each cut; requests and counts meet by a shuffle on the
   part (a part that very many candidates ask for is split by AQE, its count being one row), and the answers meet their candidate by another.
4. The cut with the least score counts (ties: fewer words first); a candidate inside a longer one that has ``share`` percent of its
   count or more goes, also where the longer one goes itself.

Scores are whole numbers of 38 digits throughout. Null texts are empty, a null lang is ``und``. Repeated rows count each. Ties of score
and count are ordered by the phrase's bytes. A text or piece of any length is one row. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import os
import shutil
import uuid

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import by_shard, materialize, new_folder, shards_for, table

WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Bytes of text whose pieces are put together in a task before they leave it, bytes of text a bucket answers for, memory of one DuckDB.
HELD, BUCKET, MEMORY = 8 << 20, 8 << 20, "200MB"
#: Parts into which a language's candidates are ranked before the best of all parts are.
PARTS = 64
PACKETS = "shard int, data binary"
#: Capitals become small, ends of pieces a line feed, the tab a blank: bytes below 128, so never a part of another character.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[ord(c) for c in ".,;:!?\x0b\x0c\r"]] = 10
FOLD[9] = 32


def _folded(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch with small letters, line feeds at the ends of pieces and blanks between words."""
    text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    _, offsets, data = text.buffers()
    data = pa.py_buffer(FOLD[np.frombuffer(data, np.uint8)]) if data is not None and data.size else data
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, offsets, data], offset=text.offset)


def _pieces(lang: pa.Array, text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Languages and pieces of folded texts: words with one blank between them, pieces without words left out."""
    cut = pc.split_pattern(text, "\n")
    lang, piece = lang.take(pc.list_parent_indices(cut)), pc.list_flatten(cut)
    if pc.any(pc.match_substring(piece, "  ")).as_py():
        piece = pc.replace_substring_regex(piece, " +", " ")
    piece = pc.utf8_trim(piece, " ")
    some = pc.not_equal(piece, "")
    return lang.filter(some), piece.filter(some)


def _grams(lang: pa.Array, piece: pa.Array, m: pa.Array, n: int) -> pa.Table:
    """Each place of ``n`` words within a piece: language, phrase, weight."""
    cut = pc.split_pattern(piece, " ")
    owner, word = pc.list_parent_indices(cut).to_numpy(), pc.list_flatten(cut)
    at = np.arange(max(0, len(word) - n + 1))
    at = at[owner[at] == owner[at + n - 1]]
    phrase = pc.binary_join_element_wise(*(word.take(pa.array(at + k)) for k in range(n)), " ") if n > 1 else word
    of = pa.array(owner[at])
    return pa.table({"lang": lang.take(of), "phrase": phrase, "m": m.take(of)})


class _Counter:
    """A DuckDB of one task, with sums of ``m`` by language and string, spilled beyond ``MEMORY`` to a folder of its own in the shared store."""

    def __init__(self, folder: str, value: str):
        self.value, self.folder = value, None
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        if folder.startswith(("file:", "/")):
            self.folder = f"/{folder.removeprefix('file:').lstrip('/')}/{uuid.uuid4().hex}"
            os.makedirs(self.folder)
            self.db.execute(f"SET temp_directory = '{self.folder}'")
        else:
            self.db.execute("SET temp_directory = ''; SET memory_limit = '600MB'")
        self.db.execute(f"CREATE TABLE held (lang VARCHAR, {value} VARCHAR, m BIGINT)")

    def add(self, rows: pa.Table) -> None:
        self.db.register("batch", rows)
        self.db.execute(f"INSERT INTO held SELECT lang, {self.value}, CAST(sum(m) AS BIGINT) FROM batch GROUP BY ALL")
        self.db.unregister("batch")

    def summed(self, having: int = 1):
        """Batches of (lang, value, m)."""
        return self.db.sql(f"SELECT lang, {self.value}, CAST(sum(m) AS BIGINT) AS m FROM held GROUP BY ALL HAVING sum(m) >= {having}").to_arrow_reader(1 << 17)

    def packets(self, n: int):
        """(bucket, Arrow rows) of all sums, each bucket's rows in order, so that neighbours share their beginnings."""
        order = f"SELECT CAST(hash({self.value}) % {n} AS INTEGER) AS b, lang, {self.value}, CAST(sum(m) AS BIGINT) AS m FROM held GROUP BY ALL ORDER BY b, lang, {self.value}"
        for rows in self.db.sql(order).to_arrow_reader(1 << 20):
            bucket = rows.column("b").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a < b:
                    yield int(bucket[a]), _packed(pa.table({"lang": rows.column("lang"), self.value: rows.column(self.value), "m": rows.column("m")}).slice(a, b - a))

    def close(self) -> None:
        self.db.close()
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    rows = rows.set_column(0, "lang", rows.column("lang").combine_chunks().dictionary_encode())
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    rows = pa.ipc.open_stream(data).read_all()
    return rows.set_column(0, "lang", rows.column("lang").cast(pa.string()))


def _out(packets):
    for shard, data in packets:
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "data": pa.array([data], pa.binary())})


def distinct_pieces(docs: DataFrame, n: int, folder: str) -> DataFrame:
    """(shard, data): packets of distinct pieces with multiplicities, by hash of the piece."""

    def task(batches):
        held, size = None, 0
        for b in batches:
            text = _folded(b)
            for at in range(0, b.num_rows, 256):
                lang, piece = _pieces(b.column("lang").slice(at, 256), text.slice(at, 256))
                if held is None:
                    held = _Counter(folder, "piece")
                held.add(pa.table({"lang": lang, "piece": piece, "m": pa.array(np.ones(len(piece), np.int64))}))
                size += piece.nbytes
                if size >= HELD:
                    yield from _out(held.packets(n))
                    held.close()
                    held, size = None, 0
        if held is not None:
            yield from _out(held.packets(n))
            held.close()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string")).mapInArrow(task, PACKETS)


def gram_packets(pieces: DataFrame, n: int, words: int, folder: str) -> DataFrame:
    """(shard, data): packets of the n-grams of each bucket of pieces, weighted, by hash of the n-gram; shard -1: words of each language."""

    def make(shard, batches):
        pieces_, grams, total = _Counter(folder, "piece"), _Counter(folder, "phrase"), {}
        for b in batches:
            for data in b.column("data").to_pylist():
                pieces_.add(_unpacked(data))
        for rows in pieces_.summed():
            lang, m = rows.column("lang"), rows.column("m")
            for k in range(1, words + 1):
                made = _grams(lang, rows.column("piece"), m, k)
                if k == 1:
                    for r in made.group_by("lang").aggregate([("m", "sum")]).to_pylist():
                        total[r["lang"]] = total.get(r["lang"], 0) + r["m_sum"]
                grams.add(made)
        pieces_.close()
        yield from _out(grams.packets(n))
        grams.close()
        yield from _out([(-1, _packed(pa.table({"lang": pa.array(list(total), pa.string()), "phrase": pa.array([""] * len(total)), "m": pa.array(list(total.values()), pa.int64())})))])

    return by_shard(pieces, n, make, PACKETS)


def gram_counts(packets: DataFrame, n: int, least: int, folder: str) -> DataFrame:
    """(lang, phrase, f): n-grams with ``least`` occurrences or more, and for the phrase ``''`` the words of the language."""

    def make(shard, batches):
        grams = _Counter(folder, "phrase")
        for b in batches:
            for data in b.column("data").to_pylist():
                grams.add(_unpacked(data))
        for rows in grams.summed(least if shard >= 0 else 1):
            yield pa.RecordBatch.from_arrays([rows.column("lang").cast(pa.string()), rows.column("phrase").cast(pa.string()), rows.column("m")], ["lang", "phrase", "f"])
        grams.close()

    return by_shard(packets.withColumn("shard", F.when(F.col("shard") < 0, n).otherwise(F.col("shard"))), n + 1, lambda s, b: make(-1 if s == n else s, b), "lang string, phrase string, f long")


def counts(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to ``words`` words that occur ``least`` times or more in a language; phrase '' counts all words."""
    spark, n = docs.sparkSession, shards_for(docs, BUCKET)
    folder = new_folder(spark, "collocations-spill")
    pieces = distinct_pieces(docs, n, folder)
    return materialize(gram_counts(gram_packets(pieces, n, words, folder), n, least, folder), "collocations-counts")


def scored(counted: DataFrame, words: int = WORDS) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each candidate, by its lowest-scoring cut."""
    big = F.col("f").cast("decimal(38,0)")
    many = counted.where(F.instr("phrase", " ") > 0).select("lang", "phrase", "f", F.split("phrase", " ").alias("w"))
    cuts = many.select("lang", "phrase", "f", F.posexplode(F.expr("transform(sequence(1, size(w) - 1), k -> array(array_join(slice(w, 1, k), ' '), array_join(slice(w, k + 1, size(w) - k), ' ')))")).alias("cut", "parts"))
    requests = cuts.select("lang", "phrase", "cut", "f", F.posexplode("parts").alias("side", "part"))
    found = counted.where("phrase != ''").select("lang", F.col("phrase").alias("part"), F.col("f").alias("n"))
    answers = requests.join(found, ["lang", "part"])
    both = answers.groupBy("lang", "phrase", "cut").agg(F.first("f").alias("f"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    weakest = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "f", "l", "r")).alias("c"))
    return weakest.select("lang", "phrase", F.col("c.f").alias("a"), F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))


def kept(candidates: DataFrame, share: int = SHARE, words: int = WORDS) -> DataFrame:
    """Candidates that lie in no longer one with ``share`` percent of their count or more."""
    w = candidates.where(F.size(F.split("phrase", " ")) > 2).select("lang", "a", F.split("phrase", " ").alias("w"))
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    longest = w.select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    joined = candidates.join(longest, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"))).drop("longer")


def top(candidates: DataFrame, limit: int = TOP) -> DataFrame:
    """Each language's first ``limit`` with their rank: the best of each part of a language first, then of all parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = candidates.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, share: int = SHARE, limit: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``limit`` phrases of 2 to ``words`` words."""
    counted = counts(docs, words, least)
    total = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return top(kept(scored(counted), share), limit).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = {
    "op12_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_LARGE}', '{_SMALL}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
d AS (SELECT lang, piece, count(*) AS m FROM p GROUP BY ALL),
w AS (SELECT lang, m, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, m, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, n AS words, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, CAST(sum(m) AS HUGEINT) AS f FROM g, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words > 1 AND f >= {LEAST}),
k AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, len(w)), ' ') AS y FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < len(w)),
s AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, (1000000 * a * a) // (l.f * r.f) AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x JOIN f r ON r.lang = k.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE len(w) = 3) GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM z JOIN t USING (lang) WHERE rank <= {TOP}
"""
}
QUERIES = {"op12_collocations": op12_collocations}

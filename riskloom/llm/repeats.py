"""Removal of repeated byte strings: a distributed difference-cover sort of suffixes, to a bounded depth.

A byte goes where a string of ``length`` bytes over it also starts anywhere else. Sorting all suffixes
would move every position; the difference cover moves few:

1. **Sample.** Positions p of each text with p mod ``period`` in a difference cover: any two positions have
   a common offset below ``period`` after which both are sampled. A text's tuples of ``period`` bytes
   at sampled positions get names; whoever has a name alone is settled.
2. **Recurse on names.** Along the stride of a tuple the names form a string over which triples
   (name(p), name(p + s), name(p + 2 s)) are sorted and named again, s growing threefold a level,
   as long as the triple still lies in any repeat that contains its position. With ``period`` 3 this is the
   textbook's recursion on triples of bytes; the default, 91 with a perfect cover of 10, samples 11 % of positions
   and needs one level of triples.
3. **Merge the remaining suffixes.** A repeat holds a surviving triple within its first ``period`` bytes, so the
   suffixes that remain, sampled or not, are those at most ``period`` - 1 before a surviving triple.
4. **Compare adjacent prefixes.** They are sorted by the fingerprint of their first ``length`` bytes
   (96 bits; equal prefixes are neighbours, whatever the order of unequal ones), and neighbours compared.

Names are 64-bit fingerprints, so tasks agree on them without a table. Keys of a block of texts travel as
one packed, sorted row to each range of keys it meets (rows: at most one a key), answers as bits; a key is sent
once a block, so a passage that a third of all texts share costs each range one entry a block. Blocks of text wait in
files of the shared folder, packets only in the shuffle; what ended attempts have left there is never read. Equal texts are found first, by 128-bit digests:
of each such group one text takes part for the others.

Null texts are empty. Texts shorter than ``length`` stay whole. Repeated rows are copies of each other and go whole,
repeats within one text count. Null and repeated doc_ids stay as they are. Other columns are ignored, whatever their names.
An empty table gives an empty one. There is no limit on a text's length but that it fits a row.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import by_shard, materialize, mix, new_folder, pack, read_file, shard_of, shards_for, table, texts, unpack, write_file

LENGTH, PERIOD = 400, 91
#: Difference covers of their period, but for the first perfect ones (each difference once).
COVERS = {3: (1, 2), 7: (0, 1, 3), 31: (1, 5, 11, 24, 25, 27), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)}
#: Bytes of text in a block, positions looked at together, bytes of text that one range of keys answers for.
BLOCK, STEP, SHARE = 2 << 20, 1 << 18, 12 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


# -- fingerprints of the windows of a block ------------------------------------------------------


def _table(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[which]))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_known: dict[int, tuple] = {}


def _constants(which: int, width: int) -> tuple:
    """Byte values, powers of the base, powers of its inverse modulo 2**64."""
    if which not in _known or len(_known[which][1]) < STEP + width:
        base = BASES[which]
        _known[which] = _table(which), _powers(base, STEP + width), _powers(pow(base, -1, 1 << 64), STEP + width)
    return _known[which]


def fingerprints(data: np.ndarray, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """64-bit fingerprints of the ``width`` bytes from each of the ascending positions ``at``."""
    values, up, down = _constants(which, width)
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + STEP, STEP))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            part = data[k * STEP : (k + 1) * STEP + width]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * up[: len(part)], out=sums[1:])
            here = at[a:b] - k * STEP
            out[a:b] = (sums[here + width] - sums[here]) * down[here]
    return mix(out)


def sampled(starts: np.ndarray, sizes: np.ndarray, period: int, width: int) -> np.ndarray:
    """Positions in the block whose place in their text is in the cover, with ``width`` bytes after them."""
    out = []
    for d in COVERS[period]:
        n = np.maximum(0, -(-(sizes - width + 1 - d) // period))
        ends = np.cumsum(n)
        out.append(np.repeat(starts + d - (ends - n) * period, n) + np.arange(ends[-1] if len(ends) else 0) * period)
    return np.sort(np.concatenate(out))


def before(at: np.ndarray, starts: np.ndarray, sizes: np.ndarray, period: int, length: int) -> np.ndarray:
    """Positions at most ``period`` - 1 before one of ``at``, in the same text, with ``length`` bytes after them."""
    if not len(at):
        return at
    text = np.searchsorted(starts, at, "right") - 1
    low, high = np.maximum(at - period + 1, starts[text]), np.minimum(at, starts[text] + sizes[text] - length)
    low = np.maximum(low, np.concatenate([[0], np.maximum.accumulate(high)[:-1] + 1]))
    n = np.maximum(0, high - low + 1)
    ends = np.cumsum(n)
    return np.repeat(low - (ends - n), n) + np.arange(ends[-1])


def depths(period: int, length: int) -> list[int]:
    """Bytes under a name, level by level: a triple must lie in a repeat of which up to ``period`` - 1 bytes precede it."""
    out = [period]
    while 3 * out[-1] <= length - period + 1:
        out.append(3 * out[-1])
    return out


# -- blocks ---------------------------------------------------------------------------------------


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out = []
    while data:
        size = int.from_bytes(data[:8], "little")
        out.append(data[8 : 8 + size])
        data = data[8 + size :]
    return out


#: What a text is among its equals.
ALONE, FIRST, COPY = 0, 1, 2


class Block:
    """The texts of a block; those that take part lie one after the other in ``data``."""

    def __init__(self, path: str, role: np.ndarray):
        sizes, data = _split(read_file(path))
        self.every = unpack(sizes).astype(np.int64)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        live = role != COPY
        self.data = data if live.all() else data[np.repeat(live, self.every)]
        self.sizes = self.every[live]
        self.starts = np.cumsum(self.sizes) - self.sizes


def blocks(docs: DataFrame, folder: str, length: int, size: int = BLOCK) -> DataFrame:
    """(block, slot, doc_id, n_bytes, high, low, path) of each text of ``length`` bytes or more; of others slot null and ``kept``."""
    schema = "block long, slot int, doc_id long, n_bytes long, high long, low long, path string, kept binary"

    types = {"block": pa.int64(), "slot": pa.int32(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "high": pa.int64(), "low": pa.int64(), "path": pa.string(), "kept": pa.binary()}

    def task(batches):
        context = TaskContext.get()
        block, rows, held, size_ = (context.partitionId() if context else 0) << 32, [], [], 0

        def flush():
            path = f"{folder}/{uuid.uuid4().hex}" if held else None
            if held:
                write_file(path, _join([pack(np.array([len(h) for h in held])), zstandard.ZstdCompressor(level=3).compress(b"".join(held))]))
            whole = [(block, slot, doc_id, n, high, low, None if slot is None else path, kept) for slot, doc_id, n, high, low, kept in rows]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*whole), types.values())], list(types))

        for b in batches:
            for doc_id, text in (pair for at in range(0, b.num_rows, 256) for pair in zip(b.column("doc_id").slice(at, 256).to_pylist(), texts(b.slice(at, 256)))):
                if len(text) < length:
                    rows.append((None, doc_id, len(text), None, None, text))
                else:
                    rows.append((len(held), doc_id, len(text), *np.frombuffer(xxhash.xxh3_128_digest(text), np.int64).tolist(), None))
                    held.append(text)
                size_ += len(text)
                if size_ >= size:
                    yield flush()
                    block, rows, held, size_ = block + 1, [], [], 0
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, schema)


def roles(rows: DataFrame) -> DataFrame:
    """(block, slot, doc_id, path, role) of the texts in blocks. Copies are counted before the shuffle; a group is one row of the join's other side."""
    held, place = rows.where("slot is not null"), F.struct("block", "slot")
    first = held.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    role = F.when(F.col("first").isNull(), ALONE).when(F.col("first") == place, FIRST).otherwise(COPY)
    return held.join(first, ["high", "low"], "left").select("block", "slot", "doc_id", "path", role.alias("role"))


def _packets(keys: np.ndarray, n: int, extra: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """(range, packed keys) of ascending keys, for the ranges that have any."""
    shard = shard_of(keys, n).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        parts = [pack(keys[a:b], ascending=True)]
        if extra is not None:
            parts.append(extra[a:b].tobytes())
        out.append((int(shard[a]), _join(parts)))
    return out


def _in_order(keys: np.ndarray, extra: np.ndarray | None):
    """Their order, and for each but the first in it whether it equals the one before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if extra is not None and (same & (extra[order[1:]] != extra[order[:-1]])).any():
        order = np.lexsort((extra, keys))
        same = (keys[order[1:]] == keys[order[:-1]]) & (extra[order[1:]] == extra[order[:-1]])
    return order, same


def shared_keys(rows: DataFrame, n: int) -> DataFrame:
    """Of each packet a bit a key: whether another block sent it too. Keys of a range are sorted and neighbours compared."""

    def answer(shard, batches):
        ids, keys, extra = [], [], []
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                parts = _split(data)
                ids.append(block)
                keys.append(unpack(parts[0], ascending=True))
                extra.append(np.frombuffer(parts[1], np.uint32) if len(parts) > 1 else None)
        every = np.concatenate(keys)
        order, same = _in_order(every, None if extra[0] is None else np.concatenate(extra))
        twice = np.zeros(len(every), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for block, k, end in zip(ids, keys, np.cumsum([len(k) for k in keys])):
            bits = zstandard.ZstdCompressor(level=1).compress(np.packbits(twice[end - len(k) : end]).tobytes())
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "shard": pa.array([shard], pa.int32()), "data": pa.array([bits], pa.binary())})

    return by_shard(rows.select("shard", "block", "data"), n, answer, PACKETS)


def _answers(got: dict[int, bytes], keys: np.ndarray, n: int) -> np.ndarray:
    """The bits of all ranges, in the order of the ascending keys that were sent."""
    shard, out = shard_of(keys, n).astype(np.int64), []
    for s, count in zip(*np.unique(shard, return_counts=True)):
        raw = zstandard.ZstdDecompressor().decompress(got[int(s)])
        out.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=int(count)).astype(bool))
    return np.concatenate(out) if out else np.zeros(0, bool)


def _distinct(keys: np.ndarray, extra: np.ndarray | None = None):
    """Ascending distinct keys (with their second parts), how often each is there, and the number of each key given."""
    order, same = _in_order(keys, extra)
    new = np.concatenate([np.ones(min(1, len(keys)), bool), ~same])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return keys[order[new]], None if extra is None else extra[order[new]], np.bincount(number, minlength=int(new.sum())), number


class Step:
    """What a block asks at each level and what it makes of the answers: the same from the same state, whenever it runs."""

    def __init__(self, state: bytes, period: int, length: int):
        path, role, ids, null, at = _split(state)
        self.path, self.role = path.decode(), np.frombuffer(role, np.int8)
        self.ids, self.null = unpack(ids), unpack(null)
        self.at = unpack(at, ascending=True).astype(np.int64)
        self.block, self.period, self.length, self.levels = Block(self.path, self.role), period, length, depths(period, length)

    @staticmethod
    def state(path: str, role: np.ndarray, ids: np.ndarray, null: np.ndarray, at: np.ndarray) -> bytes:
        return _join([path.encode(), role.astype(np.int8).tobytes(), pack(ids), pack(null), pack(at.astype(np.uint64), ascending=True)])

    def tuples(self):
        """Sampled positions and the names of the tuples there."""
        at = sampled(self.block.starts, self.block.sizes, self.period, self.period)
        return at, fingerprints(self.block.data, at, self.period), None

    def triples(self, depth: int):
        """Positions with a name that have names a third and two thirds of ``depth`` further on, and the names of the triples."""
        s, at = depth // 3, self.at
        name = fingerprints(self.block.data, at, s)
        text = np.searchsorted(self.block.starts, at, "right") - 1
        whole, parts = at + depth <= (self.block.starts + self.block.sizes)[text], [name]
        for k in (s, 2 * s):
            i = np.minimum(np.searchsorted(at, at + k), max(0, len(at) - 1))
            whole &= at[i] == at + k
            parts.append(name[i])
        a, b, c = (x[whole] for x in parts)
        with np.errstate(over="ignore"):
            return at[whole], mix(mix(a * np.uint64(BASES[0]) + b) * np.uint64(BASES[1]) + c), None

    def prefixes(self):
        """The suffixes that remain, with both parts of the fingerprint of their first ``length`` bytes."""
        b = self.block
        at = before(self.at, b.starts, b.sizes, self.period, self.length)
        return at, fingerprints(b.data, at, self.length), (fingerprints(b.data, at, self.length, 1) >> np.uint64(32)).astype(np.uint32)

    def question(self, level: int):
        """Positions, their keys, and the keys' second parts."""
        if level == 0:
            return self.tuples()
        return self.triples(self.levels[level]) if level < len(self.levels) else self.prefixes()

    def ask(self, level: int, n: int) -> list[tuple[int, bytes]]:
        """The packets for the ranges."""
        _, keys, extra = self.question(level)
        keys, extra, _, _ = _distinct(keys, extra)
        return _packets(keys, n, extra)

    def hear(self, level: int, got: dict[int, bytes], n: int) -> np.ndarray:
        """The positions whose keys are there twice, in this block or with another."""
        at, keys, extra = self.question(level)
        keys, _, count, number = _distinct(keys, extra)
        return at[((count > 1) | _answers(got, keys, n))[number]]

    def results(self, repeated: np.ndarray) -> pa.Table:
        """RESULT of the block's texts, from all positions whose ``length`` bytes start elsewhere too."""
        b, spans, kept = self.block, [], []
        text = np.searchsorted(b.starts, repeated, "right") - 1
        new = np.ones(len(repeated), bool)
        new[1:] = (np.diff(repeated) > self.length) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        begin, end = repeated[first], repeated[np.concatenate([first[1:], [len(repeated)]]).astype(np.int64)[: len(first)] - 1] + self.length
        cut = np.searchsorted(text[first], np.arange(len(b.sizes) + 1))
        live = np.cumsum(self.role != COPY) - 1
        for role, size, i in zip(self.role.tolist(), b.every.tolist(), live.tolist()):
            if role != ALONE:
                spans.append([{"start": 0, "end": size}])
                kept.append(b"")
                continue
            start, at, rest, own = int(b.starts[i]), int(b.starts[i]), [], []
            for s, e in zip(begin[cut[i] : cut[i + 1]].tolist(), end[cut[i] : cut[i + 1]].tolist()):
                own.append({"start": s - start, "end": e - start})
                rest.append(b.data[at:s].tobytes())
                at = e
            rest.append(b.data[at : start + size].tobytes())
            spans.append(own)
            kept.append(b"".join(rest))
        ids = pa.array(self.ids.view(np.int64), mask=self.null.astype(bool))
        return pa.table({"doc_id": ids, "n_bytes": pa.array(b.every), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})


STATE, PACKETS = "block long, data binary", "block long, shard int, data binary"


def _state(block: int, state: bytes) -> pa.Table:
    return pa.table({"block": pa.array([block], pa.int64()), "data": pa.array([state], pa.binary())})


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text's removed ranges of bytes (end exclusive) and the bytes that stay.

    ``period`` is one of ``COVERS``, at most (``length`` + 1) / 2: any gives the same rows, a larger one samples fewer positions.
    """
    if 2 * period > length + 1:
        raise ValueError(f"a period of {period} needs repeats of {2 * period - 1} bytes or more")
    spark, n, last = docs.sparkSession, shards_for(docs, SHARE), len(depths(period, length))
    rows = materialize(blocks(docs, new_folder(spark, "repeats-texts"), length), "repeats-rows")
    whole = lambda df: df.repartition(n, "block").groupBy("block")  # noqa: E731  a group is a block: BLOCK bounds it, but for one text; rows are few and work is much, so AQE may not merge tasks

    def start(told: pa.Table) -> pa.Table:
        told = told.sort_by("slot")
        ids = told.column("doc_id").combine_chunks()
        state = Step.state(told.column("path")[0].as_py(), told.column("role").to_numpy(), ids.fill_null(0).to_numpy().view(np.uint64), ids.is_null().to_numpy(zero_copy_only=False), np.zeros(0))
        return _state(told.column("block")[0].as_py(), state)

    def asked(level: int):
        def task(batches):
            for b in batches:
                for block, state in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                    for shard, data in Step(state, period, length).ask(level, n):
                        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "shard": pa.array([shard], pa.int32()), "data": pa.array([data], pa.binary())})

        return state.repartition(n, "block").mapInArrow(task, PACKETS)

    def heard(level: int, told: pa.Table):
        got = dict(zip(told.column("shard").to_pylist(), told.column("data").to_pylist()))
        step = Step(got[-1], period, length)
        return step, step.hear(level, got, n)

    def go_on(level: int):
        def task(told: pa.Table) -> pa.Table:
            step, at = heard(level, told)
            return _state(told.column("block")[0].as_py(), step.state(step.path, step.role, step.ids, step.null, at))

        return task

    def end(told: pa.Table) -> pa.Table:
        step, repeated = heard(last, told)
        return step.results(repeated)

    state = materialize(whole(roles(rows)).applyInArrow(start, STATE), "repeats-state")
    for level in range(last + 1):
        told = whole(state.select("block", F.lit(-1).alias("shard"), "data").unionByName(shared_keys(asked(level), n)))
        state = materialize(told.applyInArrow(go_on(level), STATE), "repeats-state") if level < last else told.applyInArrow(end, RESULT)
    short = rows.where("slot is null").select("doc_id", "n_bytes", F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), "kept")
    return state.unionByName(short)


def op11_suffix_array(spark, sf_dir):
    made = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return made.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_suffix_array": op11_suffix_array}
#: A repeat's bytes are beyond SQL at whole texts' size (every position of every text is a row): a test holds the query against brute force.
SQL: dict[str, str] = {}

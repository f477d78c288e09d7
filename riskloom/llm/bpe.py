"""Byte-level BPE over a whole corpus: each distinct word is encoded once, wherever it stands.

Tasks cut texts into pre-tokens and number them by place; a block of texts keeps, for every place, the
number of its word in the block (most frequent first). The words of a block, each once, go to shards
by hash; a shard meets the words of all blocks one block after the other, encodes each distinct one once
(of a shard with more than ``KNOWN`` words a word again after others), and sends the ids back to the
blocks in the order in which they asked. A block then puts the ids of its words at their
places, which wait for them in a file of the shared folder. Words and ids travel packed, a row for each block and shard, so a word that makes up a third of
all text costs one entry a block. Decoding joins ids with the table of token bytes.

Null texts are empty and have no tokens. Text of any length is one entry of one block. Repeated rows
give repeated results, a null doc_id stays null. Other columns are ignored. An empty table gives an
empty one. Ids are those of the ranks alone: strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskloom.llm.shared import by_shard, materialize, new_folder, pack, read_file, shard_of, shards, slices, table, unpack, write_file

VOCABULARY, BLOCK = "byte_bpe_50k.tiktoken", 12 << 20
KNOWN = 500_000
_ranks: dict[str, dict[bytes, int]] = {}
_coders: dict[str, tiktoken.Encoding] = {}


def ranks(path: str) -> dict[bytes, int]:
    if path not in _ranks:
        with open(path, "rb") as f:
            _ranks[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _ranks[path]


def coder(path: str) -> tiktoken.Encoding:
    """Encodes one pre-token: its pattern takes any text whole."""
    if path not in _coders:
        _coders[path] = tiktoken.Encoding("word", pat_str="(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})
    return _coders[path]


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Local(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def blocks(docs: DataFrame, n: int, folder: str, size: int = BLOCK, carry: str | None = None) -> DataFrame:
    """(block, shard, data): for shard -1 the file of the places of the block's words, for the others words to be encoded.

    ``carry`` names a column of whole numbers, none null, that goes with each document.
    """
    find = regex.compile(public_tokenizers.PATTERN).findall

    def task(batches):
        context = TaskContext.get()
        first, count = (context.partitionId() if context else 0) << 32, 0

        def out(ids, carried, parts, local):
            sizes = np.array([len(p) for p in parts], np.int64)
            every = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            rank = np.argsort(-np.bincount(every, minlength=len(local)), kind="stable")
            place = np.empty(len(rank), np.int32)
            place[rank] = np.arange(len(rank), dtype=np.int32)
            words = np.array(list(local), object)[rank].tolist()
            raw = [w.encode() for w in words]
            shard = shard_of(np.array([xxh64_intdigest(w) for w in raw], np.uint64), n).astype(np.int64)
            null = np.array([i is None for i in ids], np.uint64)
            head = [pack(np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)), pack(null), pack(sizes), pack(shard), pack(place[every]), pack(np.array(carried, np.int64).view(np.uint64))]
            path = f"{folder}/{uuid.uuid4().hex}"
            write_file(path, b"".join(len(h).to_bytes(8, "little") + h for h in head))
            rows = [(-1, path.encode())]  # only this row leads to the file: what an ended attempt has left is never read
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(n + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                asked = [raw[i] for i in order[cuts[s] : cuts[s + 1]]]
                sizes_ = pack(np.array([len(w) for w in asked]))
                rows.append((int(s), len(sizes_).to_bytes(8, "little") + sizes_ + _squeeze(b"".join(asked))))
            block = first + count
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "shard", "data"])

        ids, carried, parts, local, held = [], [], [], _Local(), 0
        for b in slices(batches):
            extra = b.column(carry).to_pylist() if carry else [0] * len(b)
            for i, text, c in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), extra):
                found = find(text or "")
                ids.append(i)
                carried.append(c)
                parts.append(np.fromiter(map(local.__getitem__, found), np.int32, len(found)))
                held += len(text or "")
                if held >= size:
                    yield out(ids, carried, parts, local)
                    count += 1
                    ids, carried, parts, local, held = [], [], [], _Local(), 0
        if ids:
            yield out(ids, carried, parts, local)

    extra = [F.col(carry).cast("long")] if carry else []
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra).mapInArrow(task, "block long, shard int, data binary")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text."""
    return _encoded(docs, path, lambda made: made, "doc_id long, ids array<int>")


def _encoded(docs: DataFrame, path: str | None, finish, schema: str, carry: str | None = None) -> DataFrame:
    """What ``finish`` makes of the (doc_id, ids, and the column to carry) of each block, in the task that put them together."""
    path = path or public_tokenizers.path(VOCABULARY)
    n = shards(docs.sparkSession)
    cut = materialize(blocks(docs, n, new_folder(docs.sparkSession, "bpe-places"), carry=carry), "bpe-blocks")

    def answer(shard, batches):
        one, known = coder(path).encode_ordinary, {}
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                size = int.from_bytes(data[:8], "little")
                ends = np.cumsum(unpack(data[8 : 8 + size]).astype(np.int64)).tolist()
                text, at, got = _spread(data[8 + size :]), 0, []
                for e in ends:
                    w = text[at:e]
                    at = e
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        ids = known[w] = one(w.decode())
                    got.append(ids)
                flat = np.array([i for g in got for i in g], np.uint64)
                sizes = pack(np.array([len(g) for g in got]))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "shard": pa.array([shard], pa.int32()), "data": pa.array([len(sizes).to_bytes(8, "little") + sizes + pack(flat)], pa.binary())})

    answers = by_shard(cut.where("shard >= 0").select("shard", "block", "data"), n, answer, "block long, shard int, data binary")

    def assemble(rows: pa.Table) -> pa.Table:
        got = dict(zip(rows.column("shard").to_pylist(), rows.column("data").to_pylist()))
        head, parts = read_file(got[-1].decode()), []
        while head:
            size = int.from_bytes(head[:8], "little")
            parts.append(head[8 : 8 + size])
            head = head[8 + size :]
        doc_ids, null, sizes, shard, places, carried = (unpack(p).view(np.int64) for p in parts)
        count, flat, start = np.zeros(len(shard), np.int64), [], np.zeros(len(shard), np.int64)
        base_ = 0
        for s in sorted(k for k in got if k >= 0):
            size = int.from_bytes(got[s][:8], "little")
            lens, ids = unpack(got[s][8 : 8 + size]).astype(np.int64), unpack(got[s][8 + size :])
            own = np.flatnonzero(shard == s)
            count[own] = lens
            start[own] = base_ + np.cumsum(lens) - lens
            flat.append(ids.astype(np.int32))
            base_ += len(ids)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        n_of = count[places]
        ends = np.cumsum(n_of)
        tokens = flat[np.repeat(start[places] - (ends - n_of), n_of) + np.arange(ends[-1] if len(ends) else 0)]
        docs_end = np.concatenate([[0], np.cumsum(sizes)])
        offsets = np.concatenate([[0], ends])[docs_end].astype(np.int32)
        ids = pa.array([None if z else i for i, z in zip(doc_ids.tolist(), null.tolist())], pa.int64())
        extra = {carry: pa.array(carried)} if carry else {}
        return finish(pa.table({"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))} | extra))

    return cut.where("shard < 0").unionByName(answers).groupBy("block").applyInArrow(assemble, schema)


_words: dict[str, np.ndarray] = {}


def token_bytes(path: str) -> np.ndarray:
    """The bytes of each id, the vocabulary's own table of fixed size."""
    if path not in _words:
        table_ = np.full(max(ranks(path).values()) + 1, None, object)
        for word, i in ranks(path).items():
            table_[i] = word
        _words[path] = table_
    return _words[path]


def _lists(column: pa.ListArray):
    """The lists of an Arrow column as NumPy arrays, one after the other, none of them copied."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    for i in range(len(column)):
        yield flat[ends[i] : ends[i + 1]]


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` with ``bytes``: each id joined with its bytes in the vocabulary."""
    path = path or public_tokenizers.path(VOCABULARY)

    def task(batches):
        table_ = token_bytes(path)
        for b in batches:
            out = [b"".join(table_[ids].tolist()) for ids in _lists(b.column("ids"))]
            yield b.append_column("bytes", pa.array(out, pa.binary()))

    return tokens.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + ", bytes binary")


def digests(docs: DataFrame, path: str | None = None, keep_ids: bool = False, carry: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text encoded and decoded again, and its ids and the column ``carry`` if asked for."""
    path = path or public_tokenizers.path(VOCABULARY)

    def finish(made: pa.Table) -> pa.Table:
        table_ = token_bytes(path)
        names = np.array([str(i).encode() for i in range(len(table_))], object)
        count, ids_sha, text_sha = [], [], []
        for ids in (x for chunk in made.column("ids").chunks for x in _lists(chunk)):
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(b" ".join(names[ids].tolist())).hexdigest())
            text_sha.append(hashlib.sha256(b"".join(table_[ids].tolist())).hexdigest())
        out = {"doc_id": made.column("doc_id"), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        return pa.table(out | ({"ids": made.column("ids")} if keep_ids else {}) | ({carry: made.column(carry)} if carry else {}))

    return _encoded(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + (f", {carry} long" if carry else ""), carry)


def op8_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}

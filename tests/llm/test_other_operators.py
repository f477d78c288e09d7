"""Mixing, WARC, chat and n-gram model."""

import hashlib
import math
import time
import zlib
from collections import Counter
from glob import glob

import numpy as np
import pytest

from riskloom.llm import chat, mixing, ngram_trie, warc
from riskloom.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_frames_stay_within_one_block():
    share = {"a": 5, "b": 3, "c": 1}
    slots, q = mixing.frame(share), 9
    for n in range(1, q + 1):
        for s, w in share.items():
            assert abs(slots[:n].count(s) - n * w / q) < 1
    with pytest.raises(ValueError):
        mixing.shares(["a"], {"a": 0})


def test_mix_loses_nothing_and_follows_weights(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "x") for i in range(3000)] + [(None, None, "y"), (5, "hot", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, block string")
    got = mixing.mix(docs, {"hot": 2, "s0": 1}, block=8).collect()
    assert sorted((r.doc_id or -1, r.source or "") for r in got) == sorted((a or -1, b or "") for a, b, _ in rows)
    at = sorted(r.position for r in got)
    assert len(set(at)) == len(at)
    assert mixing.mix(docs.selectExpr("doc_id", "source").where("false"), {"hot": 1}).count() == 0
    clash = mixing.mix(docs.selectExpr("doc_id", "source", "1 as Block", "2 as POSITION"), {"hot": 2})
    assert [c.lower() for c in clash.columns] == ["doc_id", "source", "block", "position"]


def by_deadlines(blocks, share):
    """The order of all blocks: slot after slot, of those released the one due first; anew when a source has ended."""
    left, used, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while any(left.values()):
        live = [s for s in sorted(left) if left[s]]
        q, done, slot = sum(share[s] for s in live), dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            ready = [(-(-(done[s] + 1) * q // share[s]), s) for s in live if done[s] * q // share[s] <= slot]
            s = min(ready)[1]
            out.append((s, used[s]))
            done[s] += 1
            used[s] += 1
            left[s] -= 1
            slot += 1
    return out


def test_mix_query_by_brute_force(spark):
    got = mixing.op1_mix(spark, "/root/testdata/sf0.01").collect()
    sources, want = {}, {}
    for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source").collect():
        sources.setdefault(r.source or "", []).append(r.doc_id)
    for s, ids in sources.items():
        ids.sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    order = by_deadlines({s: -(-len(v) // mixing.BLOCK) for s, v in sources.items()}, mixing.shares(sorted(sources), mixing.target_weights()))
    for slot, (s, b) in enumerate(order):
        for i, doc in enumerate(sources[s][b * mixing.BLOCK : (b + 1) * mixing.BLOCK]):
            want[doc] = (b, slot * mixing.BLOCK + i)
    assert {r.doc_id: (r.block, r.position) for r in got} == want


def test_mix_shares_are_exact_or_refused():
    assert mixing.shares(["a", "b", "c"], {"a": 0.9, "b": 0.0001, "c": 0.00001}) == {"a": 90_000, "b": 10, "c": 1}
    near = mixing.shares(["a", "b"], {"a": 3_000_001, "b": 1_000_003})
    assert sum(near.values()) <= mixing.FRAME + 1 and abs(near["a"] / near["b"] - 3_000_001 / 1_000_003) < 1e-4
    with pytest.raises(ValueError):
        mixing.shares(["a", "b"], {"a": 1, "b": 1e-9})


def test_mix_many_sources_and_a_schedule_beyond_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i % 120}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    one = mixing.mix(docs, {"s0": 3}, block=4).collect()
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(mixing.mix(docs, {"s0": 3}, block=4).collect()) == sorted(one) and len({r.position for r in one}) == 3000


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u4", "small"), (5, "u5", "small"), (None, "u", big), (2, "u2", big)]
    pages = spark.createDataFrame([(*r, "d", 7, 0) for r in rows], "page_id long, url string, html string, digest string, refers_to long, same int")
    index = warc.write_archives(warc.with_revisits(pages), str(tmp_path)).collect()
    assert sum(r.records for r in index) == len(rows)
    got = warc.read_archives(spark.createDataFrame(index, warc.INDEX)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in got) == [(-1, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "response", 0), (4, "response", 0), (5, "response", 0)]
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert all(r.payload_digest == digest and r.payload_bytes == len(big) for r in got if r.page_id in (1, 2))
    assert warc.write_archives(warc.with_revisits(pages.where("false")), str(tmp_path)).count() == 0


def test_warc_archive_has_dictionary_frame_and_own_frames():
    records = [warc.record(i, f"http://h/{i}", "d", None, (f"<html><p>page {i} " + "common words here " * 40).encode()) for i in range(200)]
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == warc.MAGIC and int.from_bytes(data[4:8], "little") > 0
    assert len(list(warc.read_archive(data))) == 200
    for some in (records[:1], [warc.record(1, "", "d", None, b"")], [warc.record(1, "u", "d", None, (b"long %d " * 400_000) % ((7,) * 400_000))], [warc.record(i, "u", "d", None, bytes([97 + i]) * 5) for i in range(3)]):
        data = warc.archive(some)
        assert int.from_bytes(data[4:8], "little") > 0 and len(list(warc.read_archive(data))) == len(some)


def test_warc_reading_is_linear_and_notices_an_end_inside_a_record():
    records = [warc.record(i, f"http://h/{i}", "d", None, f"<p>{i * 7919}".encode()) for i in range(32_000)]
    data = warc.archive(records)
    began = time.process_time()
    assert [h["WARC-Target-URI"] for h, _ in warc.read_archive(data)] == [f"http://h/{i}" for i in range(32_000)]
    assert time.process_time() - began < 3  # half a second here; 5 s when every record copied the rest of the archive
    assert data[8:12] == warc.TRAINED
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_archive(data[:-3]))
    long_ = warc.archive([warc.record(1, "u", "d", None, bytes(range(256)) * 9000), *records[:3]])
    assert [len(b) > 2_000_000 for _, b in warc.read_archive(long_)] == [True, False, False, False]


def test_warc_archives_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.range(4000).selectExpr("id as page_id", "'u' as url", "concat('<p>', repeat(cast(id as string), 300)) as html")
    index = warc.write_archives(warc.with_revisits(pages).repartition(4), str(tmp_path), 1 << 18)
    from riskloom.llm.shared import materialize
    from pyspark.sql import functions as F

    index = materialize(index, "index")
    assert index.count() > 8 and index.where("dictionary_bytes = 0").count() == 0
    got = warc.read_archives(index).select("page_id", F.spark_partition_id().alias("t")).collect()
    assert sorted(r.page_id for r in got) == list(range(4000)) and len({r.t for r in got}) > 4


def test_chat_round_trip_of_control_strings(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b <<SYS>> ", "<s>", "[INST", "", None, "\\\\</s>\\"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said)] + [(2, 0, "assistant", "first"), (3, 0, "robot", "<</ROLE>>"), (None, 0, "user", "hi"), (None, 1, "assistant", "yo")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(turns).withColumn("back", chat.read_back("formatted")).collect()}
    for conv in (1, 2, 3, None):
        assert [(t["role"], t["text"]) for t in got[conv].back] == [(r, t or "") for c, _, r, t in rows if c == conv]
    assert not got[2].valid and not got[3].valid and got[None].valid and not got[1].valid
    loss = [p["text"] for p in got[None].parts if p["loss"]]
    assert loss == ["yo"] and "".join(p["text"] for p in got[None].parts) == got[None].formatted
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_elias_fano_finds_successors():
    rng = np.random.default_rng(7)
    for universe in (50, 1000, 1 << 40):
        values = np.unique(rng.integers(0, universe, 400, dtype=np.uint64))
        level = ngram_trie.elias_fano(values, universe, "v")
        asked = np.concatenate([values, rng.integers(0, universe, 300, dtype=np.uint64)])
        at, hit = ngram_trie.successor(level, "v", asked)
        assert (hit == np.isin(asked, values)).all() and (values[at[hit]] == asked[hit]).all()


def test_ngram_base_score_by_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: r for r in ngram_trie.op6_ngram_trie(spark, SF).collect()}
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(ngram_trie.tokens(t.encode()))
    n, v = sum(counts.values()), len(counts)
    better = []
    for i, t in rows:
        words = ngram_trie.tokens(t.encode())
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(w in counts for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0 or len(words) == 1
        better.append(r.score > r.base_score)
    assert sum(better) > 0.9 * len(better)


def test_ngram_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("a b a c",), ("a b",), ("",), (None,)], "text string")
    model = ngram_trie.train(docs)
    words = [b"a", b"b", b"c", ngram_trie.END, b"unseen"]
    from xxhash import xxh64_intdigest

    number, count = ngram_trie._numbers(model, np.array([xxh64_intdigest(w) for w in words], np.uint64))
    total = sum(10 ** ngram_trie.log10_probabilities(model, [np.array([0, 1, w])], number, count)[2] for w in range(5))
    assert abs(total - 1) < 0.08  # quantised


def test_ngram_scores_by_brute_force(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in table(spark, SF, "documents").collect()]
    trained = [ngram_trie.tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two, three, start = Counter(), Counter(), Counter(), object()
    for words in trained:
        seq = [start, start, *words, None]
        one.update(words)
        two.update(zip(seq, seq[1:-1]))
        three.update(zip(seq, seq[1:], seq[2:]))
    n, v, w2, w3 = sum(one.values()), len(one), ngram_trie.WEIGHT2, ngram_trie.WEIGHT3
    coded = lambda x: ngram_trie.VALUE[min(255, max(0, round(-math.log10(x) / ngram_trie.STEP)))]
    counted = Counter()
    for (a, b, _), c in three.items():
        counted[a, b] += c

    def log10(a, b, c):
        before = len(trained) if b is start else one[b]
        p = (one[c] + 1) / (n + v + 1) * w2 / (before + w2) + (coded(min(1, counted[b, c] / (before + w2))) if counted[b, c] else 0)
        p *= coded(w3 / (counted[a, b] + w3)) if counted[a, b] else 1
        return math.log10(min(1, p + (coded(three[a, b, c] / (counted[a, b] + w3)) if three[a, b, c] else 0)))

    got = {r.doc_id: r.score for r in ngram_trie.op6_ngram_trie(spark, SF).collect()}
    for i, t in rows:
        seq = [start, start, *ngram_trie.tokens(t)]
        assert math.isclose(got[i], sum(map(log10, seq, seq[1:], seq[2:])), rel_tol=1e-9), i


def test_ngram_triples_of_any_number_of_words():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 50, 4000).astype(np.uint64)
    real = rng.random(3998) < 0.9
    want = Counter(t for t, ok in zip(zip(seq.tolist(), seq[1:].tolist(), seq[2:].tolist()), real) if ok)
    for size in (50, ngram_trie.LOCAL + 5, (1 << 32) - 1):
        a, b, c, count = ngram_trie.triples_of(seq, real, size)
        assert dict(zip(zip(a.tolist(), b.tolist(), c.tolist()), count.tolist())) == want


def test_ngram_text_of_2_300_000_distinct_words(spark):
    size = 2_300_000
    docs = spark.range(1).selectExpr("1L as doc_id", "false as held_out", f"array_join(transform(sequence(1, {size}), x -> conv(x, 10, 36)), ' ') as text")
    r = ngram_trie.score(docs, ngram_trie.train(docs)).first()
    n = v = size + 1
    coded = lambda x: ngram_trie.VALUE[round(-math.log10(x) / ngram_trie.STEP)]
    p = coded(1 / 5) + coded(4 / 5) * (coded(1 / 9) + 8 / 9 * 2 / (n + v + 1))
    assert (r.n_tokens, r.n_known, r.train_tokens) == (n, n, n) and math.isclose(r.score / n, math.log10(p), rel_tol=1e-5)


def test_ngram_edge_rows(spark):
    schema = "doc_id long, text string, held_out boolean, score int, shard int"
    empty = spark.createDataFrame([], schema)
    assert ngram_trie.score(empty, ngram_trie.train(empty)).count() == 0
    docs = spark.createDataFrame([(None, "a b", True, 1, 2), (1, None, True, 1, 2), (1, "", True, 1, 2), (2, "a " * 100_000, True, 1, 2)], schema)
    got = ngram_trie.score(docs, ngram_trie.train(docs.where("false"))).collect()  # all held out
    assert len(got) == 4 and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in got) and sorted(r.n_tokens for r in got) == [1, 1, 3, 100_001]
    both = ngram_trie.score(docs, ngram_trie.train(docs)).collect()
    assert all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in both)


def test_chat_ties_repeats_and_more_columns(spark):
    rows = [(1, 0, "user", "b", 9), (1, 0, "user", "a", 9), (1, 0, "user", "a", 9), (1, None, "system", "s", 9), (2, 0, None, None, 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int").selectExpr("*", "1 as parts")
    got = {r.conv_id: [(t["role"], t["text"]) for t in r.back] for r in chat.format_conversations(turns).withColumn("back", chat.read_back("formatted")).collect()}
    assert got == {1: [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")], 2: [("", "")]}

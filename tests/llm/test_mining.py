"""Removal of repeats, collocations, clustering: against brute force, and the edges."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from riskloom.llm import clustering, collocations, repeats

SF = "/root/testdata/sf0.001"


def removed_by_brute_force(rows, length):
    raw, at = [(t or "").encode() for _, t in rows], defaultdict(list)
    for r, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            at[b[i : i + length]].append((r, i))
    covered = [bytearray(len(b)) for b in raw]
    for places in at.values():
        if len(places) > 1:
            for r, i in places:
                covered[r][i : i + length] = b"\1" * length
    out = []
    for (doc_id, _), b, c in zip(rows, raw, covered):
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", c)]
        out.append((doc_id, len(b), spans, bytes(x for x, y in zip(b, c) if not y)))
    return sorted(out, key=repr)


def removed(docs, length, period):
    got = repeats.remove_repeats(docs, length, period).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got), key=repr)


@pytest.mark.parametrize(("length", "period"), [(20, 3), (14, 7), (61, 31), (200, 91)])
def test_repeats_by_brute_force(spark, length, period):
    draw = random.Random(length)
    base = ["".join(draw.choice("abé") for _ in range(draw.choice([0, 5, length, 90, 300]))) for _ in range(20)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[draw.randrange(20)][draw.randrange(20) :] + base[draw.randrange(20)]) for i in range(20)]
    rows += [(None, base[3]), (None, None), (7, base[4]), (200, "a" * 700), (201, "ab" * 400), (202, ""), (203, "b" + "a" * 699)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(docs.repartition(3), length, period) == removed_by_brute_force(rows, length)


def test_repeats_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" * 10, "a", 1)], "doc_id long, text string, block string, kept int")
    assert removed(docs, 20, 3) == [(1, 10, [], b"x" * 10)]
    assert removed(docs.where("false"), 20, 3) == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, 20, 31)
    # a very long text, in blocks of its own and over many steps of the fingerprints
    draw = np.random.default_rng(1)
    long_ = "".join(map(chr, draw.integers(97, 123, 3 << 20)))
    rows = [(1, long_), (2, long_[1_000_000:1_000_700]), (3, "q" + long_[2_500_000 : 2_500_399])]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string"), 400, 91)
    assert [g[2] for g in got] == [[(1_000_000, 1_000_700)], [(0, 700)], []]


def test_covers_hold_every_difference():
    for period, cover in repeats.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert repeats.depths(3, 400) == [3, 9, 27, 81, 243] and repeats.depths(91, 400) == [91, 273]


def test_op11_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for d, n, s, k in removed_by_brute_force([tuple(r) for r in docs], 400)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op11_suffix_array(spark, SF).collect()}
    assert got == want and any(v[1] for v in want.values())


def phrases_by_brute_force(rows, least, share, limit, longest=3):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(small)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in many.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in many.items():
            if 100 * inside[p] < share * a or p not in inside:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_collocations_by_brute_force(spark):
    draw = random.Random(3)
    words = ["Alpha", "beta", "Ünder", "gamma", "x y", "delta", "nul\0", "é", "日本"]
    rows = [(draw.choice(["de", "en", None]), "".join(draw.choice(words) + draw.choice([" ", "  ", "\t", ". ", "\n", ";", " ", " "]) for _ in range(draw.randrange(60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " \t. "), *[("en", "beta gamma delta. beta gamma delta")] * 40]
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=4, limit=25).collect())
    assert got == phrases_by_brute_force(rows, 4, 50, 25)
    assert collocations.collocations(docs.where("false")).collect() == []


def test_collocations_of_four_words_and_one_long_piece(spark):
    text = " ".join(["a b c d e"] * 3000 + ["b c"] * 50)
    docs = spark.createDataFrame([("en", text), ("en", text)], "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, words=4, least=10, limit=30).collect())
    assert got == phrases_by_brute_force([("en", text)] * 2, 10, 50, 30, 4)


def lloyd(vectors, k, rounds):
    """Plain rounds over all vectors: (owner, distance) and the centroids."""
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"1:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    centroids = [list(vectors[i][1]) for i in order[:k]]
    own = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, q in vectors:
            of[own(q)[1]].append(q)
        centroids = [[sum(x) // len(of[n]) for x in zip(*of[n])] if of[n] else c for n, c in enumerate(centroids)]
    return [(i, own(q)[1], own(q)[0]) for i, q in vectors], centroids


def test_clusters_by_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 50)
    draw = random.Random(9)
    vectors = [(i, [draw.choice([-40, -39, 0, 3, 3, 70]) for _ in range(4)]) for i in range(300)]
    vectors += [(5, [3, 3, 3, 3]), (5, [3, 3, 3, 3]), (None, [0, 0, 0, 1]), (None, [0, 0, 0, 1])]
    rows = [(i, [x / 8 + 0.01 for x in q], 1) for i, q in vectors]
    rows += [(900, None, 1), (901, [1.0, None, 2.0, 3.0], 1), (902, [1.0, float("nan"), 0.0, 0.0], 1), (903, [float("inf"), 0.0, 0.0, 0.0], 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(3)
    for k, rounds in ((6, 3), (3, 0), (400, 2)):
        got, centroids = clustering.cluster(df, k, rounds, dimensions=4, scale=8)
        want, centers = lloyd(vectors, k, rounds)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert centroids.tolist() == centers
    none, centroids = clustering.cluster(df.where("false"), dimensions=4)
    assert none.collect() == [] and len(centroids) == 0
    big = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="larger than"):
        clustering.cluster(big, dimensions=4)


def test_only_what_changed_is_compared():
    q = np.array([[0], [10], [20], [21]])
    centroids = np.array([[0], [10], [20]])
    owner, distance = clustering.reassign(q, np.full(4, -1, np.int32), np.zeros(4, np.int64), centroids, np.arange(3))
    assert owner.tolist() == [0, 1, 2, 2]
    far = distance.copy()
    far[0] = 99  # a vector whose owner stayed is not measured to it again
    again, d = clustering.reassign(q, owner, far, np.array([[0], [9], [20]]), np.array([1]))
    assert again.tolist() == [1, 1, 2, 2] and d.tolist() == [81, 1, 0, 1]


@pytest.mark.parametrize(("module", "name"), [(collocations, "op12_collocations"), (clustering, "op13_delta_lloyd")])
def test_queries_against_sql(spark, module, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = module.QUERIES[name](spark, SF)
    want = con.execute(module.SQL[name])
    names = [d[0] for d in want.description]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())

"""Tokens, personal data, duplicates, fingerprints and rules against brute force on small fixtures."""

import hashlib
import itertools
import unicodedata

import public_tokenizers
import tiktoken
import xxhash

from riskloom.llm import bpe, fingerprints, perplexity, pii, quality, simhash
from riskloom.llm.shared import table

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Write to joe.x@mail.example.org or call +49 30 1234567 now"), (2, None), (3, ""), (4, "  \n\t "), (5, "card 4111 1111 1111 1111 paid"), (6, "4111 1111 1111 1112"),
    (7, "host 10.0.0.255 and 300.1.1.1"), (8, "Straße ﬁne É"), (9, "STRASSE fine É"), (10, "a b c d e f g h i j"), (10, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (11, "wort " * 30000), (12, "<|endoftext|> DE89 3704 0044 0532 0130 00 iban"),
]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as fp", "2 as score", "3 as block")


def empty(spark):
    return odd(spark).where("false")


def test_bpe_is_tiktokens_and_comes_back(spark):
    path = public_tokenizers.path(bpe.VOCABULARY)
    one = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    for docs in (odd(spark), table(spark, SF, "documents").limit(150)):
        rows = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()): one.encode_ordinary(r.text or "") for r in docs.collect()}
        got = bpe.digests(docs, keep_ids=True).collect()
        assert len(got) == docs.count()
        for r in got:
            ids = rows[(r.doc_id, r.decoded_sha256)]
            assert ids == r.ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd(spark))).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == sorted(t or "" for _, t in ODD)
    assert bpe.digests(empty(spark)).count() == 0


def test_pii_kinds_and_masks(spark):
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in pii.find(odd(spark)).collect()}
    text = dict(ODD)
    assert [text[1][s:e] for _, s, e in got[1]] == ["joe.x@mail.example.org", "+49 30 1234567"]
    assert [k for k, *_ in got[5]] == ["card"] and got[6] == [] and got[2] == [] and got[3] == []
    assert [text[7][s:e] for _, s, e in got[7]] == ["10.0.0.255"]
    assert [k for k, *_ in got[12]] == ["iban"]
    masked = {r.doc_id: r.text for r in pii.mask(odd(spark)).collect()}
    assert masked[5] == "card [CARD] paid" and masked[2] is None and pii.mask(odd(spark)).columns == odd(spark).columns
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("DE89370400440532013000")
    assert pii.find(empty(spark)).count() == 0


def brute_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_links_and_components(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, brute_fingerprint(r.text, 3)) for r in docs.collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, find(i)) for i, f in rows}


def test_simhash_all_links_of_planted_bits(spark):
    fps = [0x1234567890ABCDEF ^ m for m in (0, 1, 0b11, 0b111, 0b1111, 1 << 63, 1 << 62 | 1 << 40 | 1 << 20, 0xFF)] + [0, 7 << 30]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(zip(signed, fps), 2) if (x ^ y).bit_count() <= 3}


def test_keep_one_keeps_one_of_each_group(spark):
    kept = simhash.keep_one(odd(spark)).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(10) == 1 and None not in ids and 2 in ids and 3 not in ids
    lone = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, "other words here")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(lone).collect()) == ["other words here", "x y z"]
    assert simhash.keep_one(empty(spark)).count() == 0


def brute_canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def test_fingerprints_equal_iff_canonical_texts_are(spark):
    for docs in (odd(spark), table(spark, SF, "documents").select("doc_id", "text")):
        got = fingerprints.fingerprint_groups(docs).collect()
        by = {}
        for r in got:
            by.setdefault(brute_canonical(r.text), set()).add(r.fingerprint)
        assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


def test_fingerprints_stay_apart_when_hashes_collide(spark):
    from pyspark.sql import functions as F

    weak = lambda c: F.struct(F.length(c).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))
    docs = spark.createDataFrame([("aa",), ("bb",), ("AA",), ("c",)], "text string")
    got = {r.text: r.fingerprint for r in fingerprints.fingerprint_groups(docs, hasher=weak).collect()}
    assert got["aa"] == got["AA"] != got["bb"] and len(set(got.values())) == 3


def test_fingerprint_query_against_brute_force(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.op3_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for n, (i, text) in enumerate(rows):
        other, cut = rows[(n + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(brute_canonical(edited) == brute_canonical(text)) and r.near_next == float(brute_canonical(other) == brute_canonical(text))


def test_base_rules(spark):
    text = b"a b c a b c x\n# | one\none\n\none\n"
    assert perplexity.base(text) == (12, 18, 2, 1, 6)
    assert perplexity.base(b"") == (0, 0, 0, 0, 0)


def test_perplexity_rejects_noise_and_keeps_prose(spark):
    docs = table(spark, SF, "documents").selectExpr("doc_id", "text", "lang")
    noise = spark.createDataFrame([(-1, " ".join(f"q{i}z!x#{i * 7}" for i in range(300)), "en"), (-2, None, None), (-3, "", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.judge(docs.unionByName(noise)).collect()}
    assert not got[-1].kept and not got[-1].base_failed and got[-2].base_failed and not got[-3].kept
    passed = [r for r in got.values() if not r.base_failed]
    assert sum(r.kept for r in passed) > 0.8 * len(passed)


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs)).join(table(spark, sf, "labels"), "doc_id").collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in scored)
    assert right / len(scored) > 0.85, right / len(scored)
    good = [r for r in scored if r.quality == 1]
    assert sum(r.score >= quality.THRESHOLD for r in good) / len(good) > 0.97


def test_quality_edge_rows(spark):
    assert quality.keep_good(odd(spark)).columns == odd(spark).columns
    assert quality.keep_good(empty(spark)).count() == 0


def test_pigeonring_chain_prunes_what_a_key_brings_together(spark):
    from pyspark.sql import functions as F

    spread = sum(1 << s for s in simhash.SHIFTS[2:5])  # three bits, one in each of three segments after two equal ones
    close = 0b111 << simhash.SHIFTS[2]  # three bits in the third segment: over its budget of one
    df = spark.createDataFrame([(spread,), (close,), (0,)], "x long")
    got = {r.x: [r[f"s{i}"] for i in range(7)] for r in df.select("x", *(simhash.ring(F.col("x"), F.lit(i)).alias(f"s{i}") for i in range(7))).collect()}
    assert got[0] == [True] * 7 and not got[close][0] and any(got[close]) and any(got[spread])


def test_gram_counts_of_any_number_of_characters(spark):
    from collections import Counter

    many = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 20_000)) + "".join(chr(c) for c in range(0x20000, 0x20000 + 50_000))
    rows = [("zh", many), ("zh", "ab ab " + many[60_000:60_010]), ("en", "ab ab"), (None, None)] + [(f"l{i}", "one two") for i in range(20)]
    got = {(r.lang, r.gram): r.n for r in perplexity.count_grams(spark.createDataFrame(rows, "lang string, text string").coalesce(1)).collect()}
    want = Counter()
    for lang, text in rows:
        chars = "\x02" * 3 + "".join(w + " " for w in (text or "").split())
        want.update((lang or "", chars[i : i + 4]) for i in range(len(chars) - 3))
    assert got == want


def brute_base(text):
    words = [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def test_perplexity_query_base_columns_by_brute_force(spark):
    got = {r.doc_id: r for r in perplexity.op7_perplexity(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        if len(text or "") < 8000:  # the brute force is quadratic
            r, b = got[i], brute_base(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
            assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)


def test_perplexity_edge_rows(spark):
    got = perplexity.judge(odd(spark).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))).collect()
    assert len(got) == len(ODD) and all(r.lang == "" for r in got) and perplexity.judge(empty(spark)).count() == 0


def test_quality_fit_is_whole_and_steady(spark):
    rows = [(1 if i % 3 else i, f"The word {i} of the text is here and it was there for that with a line {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = quality.fit(docs.repartition(3), 100), quality.fit(docs.repartition(7), 100)
    assert (one["weights"] == two["weights"]).all() and one["posterior"] == two["posterior"] and one["weights"].any()
    votes = {v: 0 for v in one["posterior"]}
    for _, t in rows:
        votes["".join(map(str, quality.look(t.encode(), quality._Words())[0]))] += 1
    assert sum(votes.values()) == 900


def test_quality_query_by_its_own_parts(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model, cache = quality.fit(docs), quality._Words()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in quality.op2_quality(spark, SF).collect():
        votes, index, value = quality.look(texts[r.doc_id], cache)
        votes = "".join(map(str, votes))
        z = sum(float(model["weights"][i]) * float(v) for i, v in zip(index, value)) + float(model["weights"][-1])
        score = 1 / (1 + 2.718281828459045**-z) if len(index) else model["prior"]
        assert r.votes == votes and abs(r.posterior - model["posterior"][votes]) < 1e-5 and abs(r.score - score) < 1e-4 and r.kept == (r.score >= quality.THRESHOLD or abs(r.score - 0.5) < 1e-5)


def test_pii_query_base_spans_by_brute_force(spark):
    import re

    shapes = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def right(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    for r in pii.op9_pii(spark, SF).collect():
        found = [(m.start(), k, m.end()) for k, p in shapes.items() for m in re.finditer(p, texts[r.doc_id]) if right(k, m[0])]
        found.sort(key=lambda x: (x[0], list(shapes).index(x[1])))
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in found)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in found) for k in shapes]


def test_next_documents_of_ties_nulls_and_one_row(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    mark = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    ties = [(7, f"same id {i}") for i in range(400)] + [(i, f"text {i}") for i in range(100)] + [(None, f"none {i}") for i in range(300)] + [(5, None), (5, "twice"), (5, "twice")]
    for rows in (ties, ties[:1], [(None, None)], ties[400:410], [(3, "x")] * 50):
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as piece", "3 as mark").repartition(5)
        order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), mark(x[1]), x[1]))
        want = sorted(((a, b) for a, b in zip(order, order[1:] + order[:1])), key=str)
        got = sorted((((r.doc_id, r.text), (r.following.doc_id, r.following.text)) for r in fingerprints.with_next(docs).collect()), key=str)
        assert got == want
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_votes(text):
    """The eight labellers, each by a loop of its own."""
    words = (text or "").encode().split()
    n = len(words)
    if not n:
        return [0] * 8
    share = lambda f: sum(1 for w in words if f(w)) / n
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    echo, variety = sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n
    above = lambda x, junk, good: 2 if x > junk else 1 if x < good else 0
    below = lambda x, junk, good: 2 if x < junk else 1 if x > good else 0
    capital = lambda w: any(65 <= c <= 90 for c in w) and not any(97 <= c <= 122 for c in w) and len(w) > 1
    return [
        above(share(lambda w: any(chr(c) in "#*$%&|<>" for c in w)), 0.3, 0.05), above(share(capital), 0.5, 0.1) if n >= 5 else 0, above(share(lambda w: b"!" in w), 0.3, 0.05),
        above(echo, 0.2, 0.02) if n >= 10 else 0, below(variety, 0.15, 0.35) if n >= 50 else 0, above(repeated, 0.5, 0.3) if len(lines) >= 4 else 0,
        below(share(lambda w: w.lower().strip(b".,;:!?") in quality.FUNCTION_WORDS), 0.005, 0.05) if n >= 40 else 0, 2 if share(lambda w: len(w) > 40) > 0.1 else 0,
    ]


def test_quality_votes_and_estimation_by_a_plain_version(spark):
    import math

    docs = [r.text for r in table(spark, SF, "documents").select("text").collect()] + [None, "", "!!! WOW ### " * 40]
    votes = [plain_votes(t) for t in docs]
    cache = quality._Words()
    assert [quality.look((t or "").encode(), cache)[0] for t in docs] == votes
    counts = {}
    for v in votes:
        key = "".join(map(str, v))
        counts[key] = counts.get(key, 0) + 1
    posterior, prior, chance = quality.expectation_maximisation(counts)
    # one vote at a time: the same start, the same steps, sums in loops
    q = {p: 1 / (1 + math.exp(-(p.count("1") - 1.5 * p.count("2")) - 0.5)) for p in counts}
    for _ in range(100):
        weight = {p: (n * (1 - q[p]), n * q[p]) for p, n in counts.items()}
        own = min(0.99, max(0.01, sum(w[1] for w in weight.values()) / sum(counts.values())))
        told = [[[1.0 + sum(w[c] for p, w in weight.items() if p[j] == k) for k in "012"] for j in range(8)] for c in (0, 1)]
        told = [[[x / sum(row) for x in row] for row in side] for side in told]
        new = {}
        for p in counts:
            a, b = (math.log(s) + sum(math.log(told[c][j][int(k)]) for j, k in enumerate(p)) for c, s in ((0, 1 - own), (1, own)))
            new[p] = 1 / (1 + math.exp(max(-50, min(50, a - b))))
        moved, q = max(abs(new[p] - q[p]) for p in q), (new if max(abs(new[p] - q[p]) for p in q) >= 1e-9 else q)
        if moved < 1e-9:
            break
    assert max(abs(posterior[p] - q[p]) for p in counts) < 1e-7 and abs(prior - own) < 1e-7
    assert all(abs(chance[c][j][k] - told[c][j][k]) < 1e-7 for c in (0, 1) for j in range(8) for k in range(3))


def test_quality_linear_fit_lowers_the_loss_as_plain_steps_do():
    import math

    import numpy as np

    rows = [{"index": np.array(i, np.uint16).tobytes(), "value": np.array(v, np.float32).tobytes(), "votes": p} for i, v, p in (([1, 2], [0.5, 0.5], "a"), ([2, 3], [1.0, 0.5], "b"), ([1], [1.0], "a"), ([], [], "b"))]
    label, prior = {"a": 0.9, "b": 0.2}, 0.6
    got = quality.fit_linear(rows, label, prior, rounds=40)
    w, bias, total, bias_total = {1: 0.0, 2: 0.0, 3: 0.0}, math.log(0.6 / 0.4), dict.fromkeys((1, 2, 3), 1e-8), 1e-8
    data = [({1: 0.5, 2: 0.5}, 0.9), ({2: 1.0, 3: 0.5}, 0.2), ({1: 1.0}, 0.9)]
    for _ in range(40):
        grad, g0 = dict.fromkeys(w, 0.0), 0.0
        for x, y in data:
            gap = 1 / (1 + math.exp(-(sum(w[k] * v for k, v in x.items()) + bias))) - y
            g0 += gap
            for k, v in x.items():
                grad[k] += gap * v
        for k in w:
            g = grad[k] / 3 + 1e-6 * w[k]
            total[k] += g * g
            w[k] -= 0.5 * g / math.sqrt(total[k])
        g = g0 / 3 + 1e-6 * bias
        bias_total += g * g
        bias -= 0.5 * g / math.sqrt(bias_total)
    assert all(abs(got[k] - w[k]) < 1e-6 for k in w) and abs(got[-1] - bias) < 1e-6


def test_simhash_edges(spark):
    same = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(odd(spark)).collect()}
    assert same[2] == same[3] == same[4] == (0, 2) and same[10] == same[None] and same[10][1] == 10
    assert simhash.near_duplicates(empty(spark)).collect() == []
    long_ = spark.createDataFrame([(1, "w " * 200_000), (2, None), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(long_).collect()} == {1: 1, 2: 2, 3: 2}

"""The model of op7, its bits, bands and verdicts against plain dictionaries."""

import math
from collections import Counter, defaultdict

import pytest

from riskloom.llm import perplexity as P
from riskloom.llm.shared import table

SF = "/root/testdata/sf0.001"


def line_of(text):
    words = (text or "").encode().split()
    return "\x02" * 3 + (b" ".join(words).decode() + " " if words else "")


def plain_model(texts):
    """p(gram) and weight(context) of one language by interpolated modified Kneser-Ney."""
    counts = {4: Counter(s[i : i + 4] for s in map(line_of, texts) for i in range(len(s) - 3))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p, weight = {}, {}
    for n in (1, 2, 3, 4):
        of = Counter(counts[n].values())
        n1, n2, n3, n4 = max(of[1], 1), of[2], of[3], of[4]
        y = n1 / (n1 + 2 * n2)
        d = {}
        for k, above, own in ((1, n2, n1), (2, n3, n2), (3, n4, n3)):
            d[k] = max(0.1, min(k - (k + 1) * y * above / own if own else k - 0.5, k - 0.05))
        total, back = Counter(), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            back[g[:-1]] += d[min(c, 3)]
        for context, c in total.items():
            weight[context] = back[context] / c
        for g, c in counts[n].items():
            p[g] = (c - d[min(c, 3)]) / total[g[:-1]] + weight[g[:-1]] * (p[g[1:]] if n > 1 else P.UNSEEN)
    return p, weight


def plain_bits(text, model):
    p, weight = model
    s, bits = line_of(text), 0.0
    for i in range(3, len(s)):
        for n in (4, 3, 2, 1):
            gram = s[i - n + 1 : i + 1]
            if gram in p:
                bits -= math.log2(p[gram])
                break
            bits -= math.log2(weight.get(gram[:-1], 1.0))
        else:
            bits -= math.log2(P.UNSEEN)
    return bits


def digits3(x):
    unit = 10.0 ** (math.floor(math.log10(max(x, 0.001))) - 2)
    return round(round(max(x, 0.001) / unit) * unit, 6)


def plain_band(values):
    held = sorted(map(digits3, values))
    at = lambda q: next(v for i, v in enumerate(held, 1) if i >= len(held) * q)
    half = max((at(0.75) - at(0.25)) / 1.349 * P.WIDTH, P.FLOOR)
    return at(0.5) - half, at(0.5) + half


@pytest.fixture(scope="module")
def judged(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    noise = spark.createDataFrame([(90_001, "qzx jkv wqp " * 60, "en"), (90_002, "the of and " * 20, None), (90_003, None, "de"), (90_004, "x y " + " ".join(f"w{i}" for i in range(80)), None)], docs.schema)
    docs = docs.unionByName(noise)
    return docs.collect(), {r.doc_id: r for r in P.judge(docs).collect()}


def test_bits_of_the_model(judged):
    rows, got = judged
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r.lang or ""].append(r.text)
    models = {lang: plain_model(texts) for lang, texts in by_lang.items()}
    for r in rows:
        words = len((r.text or "").encode().split())
        if not words:
            assert got[r.doc_id].char_bits is None and not got[r.doc_id].kept
            continue
        bits = plain_bits(r.text, models[r.lang or ""])
        assert got[r.doc_id].char_bits == pytest.approx(bits / (len(line_of(r.text)) - 3), rel=1e-4)
        assert got[r.doc_id].word_bits == pytest.approx(bits / words, rel=1e-4)


def test_bands_and_verdicts(judged):
    rows, got = judged
    held = defaultdict(list)
    for r in got.values():
        if r.char_bits is not None and not r.base_failed:
            held[r.lang].append(r)
    limits = {lang: (plain_band([r.char_bits for r in rs]), plain_band([r.word_bits for r in rs])) for lang, rs in held.items()}
    verdicts = Counter()
    for r in got.values():
        fine = not r.base_failed and r.lang in limits
        if fine:
            (low, high), (word_low, word_high) = limits[r.lang]
            assert (r.char_low, r.char_high, r.word_low, r.word_high) == pytest.approx((low, high, word_low, word_high), abs=1e-6)
            fine = low <= r.char_bits <= high and word_low <= r.word_bits <= word_high
        assert r.kept == fine, r
        verdicts[r.kept] += 1
    assert verdicts[True] > 100 and not got[90_001].kept


def test_probabilities_of_a_language_sum_to_one(spark):
    texts = ["abc abd bcd abc", "dab cab", "aaa bbb ccc"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = {(r.gram, r.kind): r.value for r in P.kneser_ney(P.count_grams(docs)).collect()}
    want, weight = plain_model(texts)
    assert {g: v for (g, k), v in model.items() if k == "p"} == pytest.approx({g: math.log2(v) for g, v in want.items()})
    assert {g: v for (g, k), v in model.items() if k == "b"} == pytest.approx({g: math.log2(v) for g, v in weight.items()})
    one = {g: v for g, v in want.items() if len(g) == 1}
    assert sum(v - weight[""] * P.UNSEEN for v in one.values()) + weight[""] == pytest.approx(1.0)
    for context in {g[:-1] for g in want if len(g) == 2}:
        seen = {g[-1]: v for g, v in want.items() if g[:-1] == context and len(g) == 2}
        rest = sum(weight[context] * v for g, v in one.items() if g not in seen)
        assert sum(seen.values()) + rest == pytest.approx(1.0, abs=weight[context] * (1 - sum(one.values())) + 1e-9)

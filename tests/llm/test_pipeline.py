"""The stages of the pipeline on small fixtures."""

import itertools
from collections import Counter

import pytest

import corpus_pipeline
from riskloom.llm import mixing, pii, simhash
from riskloom.llm.shared import materialize, table

SF = "/root/testdata/sf0.001"


def test_position_follows_the_weights_to_the_end(spark):
    sizes = {"src0": 1600, "src1": 640, "src3": 320}  # weights 10, 4, 2: fifty, twenty and ten blocks, which end together
    rows = [(i * 10 + k, f"text {i} of {s}", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    source = {i: s for i, _, s in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = corpus_pipeline.bpe_stage(spark, materialize(corpus_pipeline.mixing_stage(spark, docs, ""), "mixed"), "").collect()
    assert sorted(r.position for r in out) == list(range(len(rows))) and {r.doc_id for r in out} == set(source)
    seen, total = Counter(), sum(sizes.values())
    for n, r in enumerate(sorted(out, key=lambda r: r.position), 1):
        seen[source[r.doc_id]] += 1
        assert all(abs(seen[s] - n * sizes[s] / total) < mixing.BLOCK for s in sizes)


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_dedup_finds_every_pair_of_similarity_four_fifths(spark):
    words = [f"w{i}" for i in range(94)]  # 90 shingles; k changed words at the end leave 90 - k of 90 + k
    near = [(10_000 + k, " ".join(words[: 94 - k] + [f"x{k}y{i}" for i in range(k)]), "en", "s") for k in (0, 9, 10, 11)]
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(near, "doc_id long, text string, lang string, source string"))
    rows = {r.doc_id: grams(r.text) for r in docs.collect()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(rows), 2):
        a, b = rows[i], rows[j]
        if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    assert find(10_010) == 10_000 and find(10_011) == 10_011  # 80 / 100 is near, 79 / 101 is not
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == {i: find(i) for i in rows}
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == sorted({find(i) for i in rows})


IBANS = [
    "iban DE89 3704 0044 0532 0130 00 BIC X and more", "iban DE89370400440532013000 EUR 250", "DE89 3704 0044 0532 0130 00 2024-01-01", "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX OF THE BANK",
    "KD12 DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00", "iban GB82 WEST 1234 5698 7654 32 NO 7", "iban NO9386011117947 AB", "DE89 3704 0044 0532 0130 00 Bank",
]


@pytest.mark.parametrize("text", IBANS)
def test_iban_before_capitals_and_numbers(text):
    found = [text[s:e] for kind, s, e, _ in pii.spans(text) if kind == "iban"]
    assert [x.replace(" ", "") for x in found] == ["GB82WEST12345698765432" if "GB82" in text else "NO9386011117947" if "NO93" in text else "DE89370400440532013000"]


def test_no_iban_where_the_checksum_fails():
    for text in ("iban DE88 3704 0044 0532 0130 00 BIC X", "iban DE89370400440532013000EUR", "iban xDE89370400440532013000", "AB12 " * 2000):
        assert not [x for x in pii.spans(text) if x[0] == "iban"]


def test_dedup_keeps_other_texts_of_a_repeated_doc_id(spark):
    rows = [(1, "one two three four five six", "a"), (1, "quite another text with other words", "a"), (2, "a third text that is like no other", "a"), (2, "a third text that is like no other", "b"), (None, "lone row without any name", "a"), (None, "one two three four five six", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__n` string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, rows[0][1]), (1, rows[1][1]), (2, rows[2][1]), (0, rows[4][1])])


def test_dedup_of_a_cloud_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(x if (j * 7 + i * 13) % 97 else f"v{i}" for j, x in enumerate(base))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets_ = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets_}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sets_, 2):
        if 5 * len(sets_[i] & sets_[j]) >= 4 * len(sets_[i] | sets_[j]):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == {i: find(i) for i in sets_}


CLASHING = "__score __votes __id __of __n __fp __m __d __f __least __o __source __order __piece __ps __block column_2 score votes fp node root block"


def test_stages_keep_columns_whatever_their_names(spark):
    text = "The house of the old man was by the river and it was not far from the road that we took. "
    rows = [(i, text * (1 + i % 3) if i != 2 else None, f"s{i % 2}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *(f"doc_id + {n} as `{c}`" for n, c in enumerate(CLASHING.split())))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == r.doc_id + n for n, c in enumerate(CLASHING.split()))
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert [c for c in mixed.columns if c != "position"] == docs.columns
    assert all(r["__order"] == r.doc_id + CLASHING.split().index("__order") for r in mixed.collect())


def run_of(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return docs, corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_the_whole_run_against_its_stages_in_plain_python(spark, tmp_path):
    import hashlib

    import public_tokenizers
    import tiktoken

    from riskloom.llm import bpe, quality

    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source").collect()] + [(5000, None, None, None), (5001, "", "en", "src1"), (None, "a text of no name " * 9, None, "src0")]
    docs, got = run_of(spark, tmp_path, rows)
    good = {(r.doc_id, r.text) for r in quality.score(docs, quality.fit(docs)).where(f"score >= {quality.THRESHOLD}").collect()}
    left = [r for r in rows if (r[0], r[1]) in good]
    root = list(range(len(left)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets_ = [grams(r[1]) for r in left]
    for i, j in itertools.combinations(range(len(left)), 2):
        if (not sets_[i] and not sets_[j]) or 5 * len(sets_[i] & sets_[j]) >= 4 * len(sets_[i] | sets_[j]) > 0:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    groups = {}
    for i, r in enumerate(left):
        groups.setdefault(find(i), []).append(r)
    stay = {min((r[0] is None, r[0] or 0, r[1] or "") for r in g) for g in groups.values()}
    kept = [r for g in groups.values() for r in g if (r[0] is None, r[0] or 0, r[1] or "") in stay]
    one = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    want = {}
    for doc_id, text, _, _ in kept:
        out, at = [], 0
        for kind, s, e, _ in pii.spans(text):
            if s >= at:
                out += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        masked = "".join(out) + (text or "")[at:]
        want[doc_id] = (" ".join(map(str, one.encode_ordinary(masked))), hashlib.sha256(masked.encode()).hexdigest())
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in got} == want and len(want) < len(rows)
    assert len({r.position for r in got}) == len(got)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 3])
def test_the_run_of_nothing_and_of_nulls(spark, tmp_path, rows):
    _, got = run_of(spark, tmp_path, rows)
    assert len(got) <= 1 and all(r.doc_id is None and r.n_tokens == 0 for r in got)


def test_context_words_stand_alone():
    score = lambda t, kind: next(s for k, _, _, s in pii.spans(t) if k == kind)
    for word in ("hotel", "intelligence", "telling"):
        assert score(f"{word} +49 30 1234567", "phone") == pytest.approx(0.6)
    for word in ("tel", "Tel.", "my_tel", "call:"):
        assert score(f"{word} +49 30 1234567", "phone") == pytest.approx(0.9)
    assert score("x" * 37 + "tel" + " " * 38 + "+49 30 1234567", "phone") == pytest.approx(0.6)  # cut by the window's edge
    assert score("company 4111 1111 1111 1111", "card") == pytest.approx(0.7) and score("company pay 4111 1111 1111 1111", "card") == pytest.approx(1.0)
    assert score("ghost 10.0.0.1", "ip") == pytest.approx(0.6)


def test_many_false_ibans_are_quick():
    import time

    began = time.process_time()
    assert not [x for x in pii.spans("AB12 " * 200_000) if x[0] == "iban"]
    assert time.process_time() - began < 15


def test_near_dedup_counts_shared_keys_in_place_and_leaves_no_prefixes(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40 * (i // 3), 40 * (i // 3) + 30 + i % 3))) for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr("riskloom.llm.shared.shared_dir", lambda spark: str(tmp_path))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == {i: i - i % 3 for i in range(9)}
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "weighed-keys" in left and not left & {"sets", "shared-keys"}

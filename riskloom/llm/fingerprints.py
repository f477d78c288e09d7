"""Exact fingerprints of canonical texts, in DataFrame functions only.

A text is brought to one form: Unicode composition (NFKC), full case folding, runs of white space to
one blank, none at the ends. Its fingerprint is two independently seeded xxHash64 values, 128 bits.
Where several rows share them, their canonical bytes are compared (least and greatest of a bucket,
summed up before the shuffle, so a bucket of a third of all rows costs one row a task). Texts that
differ inside a bucket get an ordinal after the hash, so a collision never merges two texts.

Null texts count as empty; empty texts are all equal. Repeated rows give repeated results. Other
columns are ignored. The next document is the one with the next smaller doc_id (null last; of equal
doc_ids by xxHash64 of the text); the first follows the last; a single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import materialize, shards, table

#: Slots of the filter that is broadcast to leave texts out of a shuffle: at most so many rows, whatever the input.
SLOTS = 1 << 20
_ICU = "com.ibm.icu"


def canonical(text):
    composed = F.reflect(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    shaped = F.when(text.rlike("[^\\x00-\\x7F]"), again).otherwise(F.lower(text))  # ASCII needs no tables
    return F.trim(F.regexp_replace(shaped, "[\\s\\x{85}\\p{Z}]+", " "))


def wide(canon):
    return F.struct(F.xxhash64(canon).alias("hi"), F.xxhash64(F.lit(1), canon).alias("lo"))


def _slots(df: DataFrame, column) -> DataFrame:
    """At most SLOTS numbers, so that a broadcast of them has a fixed bound."""
    return F.broadcast(df.select(F.pmod(F.xxhash64(column), F.lit(SLOTS)).alias("slot")).distinct())


def _in_slots(df: DataFrame, column, slots: DataFrame) -> DataFrame:
    return df.join(slots, F.pmod(F.xxhash64(column), F.lit(SLOTS)) == F.col("slot"), "left_semi")


def collisions(canons: DataFrame) -> DataFrame:
    """(h, canon, ordinal) for the buckets of ``canons(h, canon)`` that hold different bytes."""
    sums = canons.groupBy("h").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    mixed = sums.where("least != most").select("h")
    found = canons.join(mixed, "h", "left_semi").distinct()
    return found.withColumn("ordinal", F.row_number().over(Window.partitionBy("h").orderBy("canon")))


def named(df: DataFrame, columns: dict[str, str], apart: DataFrame | None, hasher=wide) -> DataFrame:
    """``df`` with a fingerprint column for each text column; ``apart``: what ``collisions`` found, if anything."""
    for text, name in columns.items():
        canon = canonical(F.coalesce(F.col(text), F.lit("")))
        df = df.withColumn("__canon", canon).withColumn("__h", hasher(F.col("__canon")))
        hashed = F.lower(F.concat(F.lpad(F.hex("__h.hi"), 16, "0"), F.lpad(F.hex("__h.lo"), 16, "0")))
        if apart is not None:
            other = apart.select(F.col("h").alias("__oh"), F.col("canon").alias("__oc"), F.col("ordinal").cast("string").alias("__n"))
            df = df.join(other, (F.col("__h") == F.col("__oh")) & (F.col("__canon") == F.col("__oc")), "left")
            df = df.withColumn(name, F.concat_ws("-", hashed, "__n")).drop("__oh", "__oc", "__n")
        else:
            df = df.withColumn(name, hashed)
        df = df.drop("__canon", "__h")
    return df


def _found(canons: DataFrame) -> DataFrame | None:
    apart = materialize(collisions(canons), "collisions")
    return apart if apart.limit(1).count() else None


def fingerprint_groups(df: DataFrame, text: str = "text", hasher=wide) -> DataFrame:
    """``df`` with ``fingerprint``: equal if and only if the canonical texts are equal."""
    canon = canonical(F.coalesce(F.col(text), F.lit("")))
    marked = df.select(canon.alias("canon")).withColumn("h", hasher(F.col("canon")))
    many = marked.groupBy("h").count().where("count > 1").select("h")
    shared = _in_slots(marked, F.col("h"), _slots(many, F.col("h")))
    return named(df, {text: "fingerprint"}, _found(shared), hasher)


def _piece(marks: list[int]):
    """How many of the sorted marks lie below doc_id, by halving; null doc_ids lie below all."""
    if not marks:
        return F.lit(0)
    held, steps = F.array(*[F.lit(m).cast("long") for m in marks]), len(marks).bit_length()

    def step(at, power):
        further = at + power
        return F.when((further <= len(marks)) & (F.try_element_at(held, further) < F.col("doc_id")), further).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(steps))]), F.lit(0), step)


def _pieces(docs: DataFrame, pieces: int):
    """The columns (piece, part) of a row: ranges of doc_id of about equal size, in order, and parts of a doc_id that fills ranges of its own.

    Rows of one doc_id (and those without one) are in the order of their texts' hashes, and parts are ranges of these.
    """
    few = [i / pieces for i in range(1, pieces)]
    facts = docs.agg(F.percentile_approx("doc_id", few, 100 * pieces).alias("m"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    marks = facts["m"] or []
    parts = {m: marks.count(m) for m in set(marks) if marks.count(m) > 1}
    # a doc_id that fills ranges ends one, and what lies below it begins another
    ends = sorted({m - 1 for m in parts} | set(marks))
    parts[None] = max(1, facts["none"] * pieces // max(1, facts["n"]))
    share = F.shiftrightunsigned(F.col("mark").bitwiseXOR(F.lit(-(1 << 63))), 33)  # the hash as a number below 2^31, in the order of hashes
    part = F.lit(0)
    for doc_id, count in parts.items():
        part = F.when(F.col("doc_id").eqNullSafe(F.lit(doc_id).cast("long")), F.shiftright(share * count, 31).cast("int")).otherwise(part)
    return F.when(F.col("doc_id").isNull(), -1).otherwise(_piece(ends)), part


def with_next(docs: DataFrame, more: dict | None = None) -> DataFrame:
    """doc_id, text (null: empty), a column for each of ``more`` (name: function of the text), and ``following``: the same of the next document.

    Rows are dealt to ranges of doc_id of about equal size; each range is read in order, and its last
    row takes the first row of the next range, of which there is one for each range.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {k: f(F.col("text")) for k, f in (more or {}).items()}
    piece, part = _pieces(docs, 4 * shards(docs.sparkSession))
    dealt = docs.withColumns({"piece": piece, "part": part})
    row = F.struct(*(c.alias(k) for k, c in made.items()))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("text")]
    placed = dealt.select("piece", "part", "mark", *(c.alias(k) for k, c in made.items()))
    placed = placed.withColumn("following", F.lead(F.struct(*made)).over(Window.partitionBy("piece", "part").orderBy(*order)))
    # the first row of each range: found by its numbers alone, and only its text is looked at
    top = F.min(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), F.col("mark"))).alias("top")
    tops = dealt.groupBy("piece", "part").agg(top).select(F.col("piece").alias("p"), F.col("part").alias("q"), (-F.col("top.col2")).alias("d"), F.col("top.mark").alias("m"))
    first = (F.col("piece") == F.col("p")) & (F.col("part") == F.col("q")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    heads = dealt.join(F.broadcast(tops), first, "left_semi").groupBy("piece", "part").agg(F.min(F.struct("text", "doc_id")).alias("h"))
    heads = materialize(heads.select("piece", "part", F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text")).select("piece", "part", row.alias("head")), "heads")
    ring = Window.orderBy(F.col("piece").desc(), "part")  # a row for each range
    here = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    after = heads.select("piece", "part", here("piece").alias("p"), here("part").alias("q"))
    nexts = after.join(heads.select(F.col("piece").alias("p"), F.col("part").alias("q"), "head"), ["p", "q"]).select("piece", "part", "head")
    # texts of any size: met by the partitioning that the window has dealt, broadcast only where Spark finds them small
    ended = placed.join(nexts, ["piece", "part"], "left")
    return ended.select(*made, F.coalesce("following", "head").alias("following"))


def edited(text, other):
    """The last third of a text replaced by as many first code points of another."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(other, F.lit(1), cut))


def op3_fingerprints(spark, sf_dir):
    """One pass deals out whole texts once; a second one moves only texts whose hashes are shared."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(source, {"h": lambda text: wide(canonical(text))})
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("following.text")))
    facts = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "h",
        wide(canonical(F.col("edited"))).alias("eh"), F.col("following.doc_id").alias("next_id"), F.col("following.h").alias("nh"),
    )
    facts = materialize(facts, "fingerprints")
    many = facts.select("h").unionAll(facts.select(F.col("eh").alias("h"))).groupBy("h").count().where("count > 1").select("h")
    own = facts.select("doc_id", "h").join(many, "h", "left_semi")
    cut = facts.select("doc_id", "next_id", F.col("eh").alias("h")).join(many, "h", "left_semi")
    own, cut = materialize(own, "shared"), materialize(cut, "shared")

    def texts_of(ids: DataFrame) -> DataFrame:
        return _in_slots(source, F.col("doc_id"), _slots(ids, F.col("doc_id")))

    a = texts_of(own).withColumn("canon", canonical(F.col("text"))).withColumn("h", wide(F.col("canon")))
    a = a.join(own.distinct(), ["doc_id", "h"], "left_semi").select("h", "canon")
    following = texts_of(cut.select(F.col("next_id").alias("doc_id"))).select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    b = texts_of(cut).join(cut.distinct(), "doc_id").join(following, "next_id")
    b = b.withColumn("canon", canonical(edited(F.col("text"), F.col("next_text")))).where(wide(F.col("canon")) == F.col("h")).select("h", "canon")
    apart = _found(a.unionAll(b))
    if apart is None:
        name = {c: F.lower(F.concat(F.lpad(F.hex(f"{c}.hi"), 16, "0"), F.lpad(F.hex(f"{c}.lo"), 16, "0"))) for c in ("h", "eh", "nh")}
        out = facts.select("doc_id", "n_chars", "edited_sha256", name["h"].alias("fingerprint"), name["eh"].alias("edited_fingerprint"), name["nh"].alias("next_fingerprint"))
    else:
        all3 = rows.select("doc_id", "text", "edited", F.col("following.text").alias("next_text"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"))
        out = named(all3, {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"}, apart)
    same = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
SQL: dict[str, str] = {}

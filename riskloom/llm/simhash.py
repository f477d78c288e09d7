"""SimHash near-duplicates: 64-bit fingerprints, pigeonring candidates, exact Hamming links, components.

The fingerprint is cut into a ring of seven segments. If two fingerprints differ in at most three
bits, there is a segment from which every chain of l segments differs in at most floor(3 l / 7) bits:
0, 0, 1, 1, 2, 2, 3. The first two segments of that chain are then equal, and of the next two one is,
so links are found by equality of three segments (27 or 28 bits), once for each start and each of the
two choices. The whole chain of budgets prunes what the keys bring together, then the Hamming
distance decides. Equal fingerprints are one node, so copies are never paired.

Null and empty texts have fingerprint zero and link like any other. A null doc_id has a fingerprint
and a component, but never names one (the smallest doc_id that is not null does; null if there is none).
Repeated rows give repeated results. Other columns are ignored. An empty table gives an empty one.

``keep_one``, the pipeline's stage, promises more: of documents whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more, one stays. No number of differing bits promises that (such pairs were
seen to differ in up to 14 of 64, and segments for 14 would have four bits), so links of three bits only
propose, and what they leave is found by prefixes. In any one order of all shingles, two sets that similar
share their first k common ones among the first n - ceil(0.8 n) + k of each; k grows with the set, so that
few other pairs share as many. The order is by how often a shingle occurs in a sample of the texts, rare
ones first: the sample decides what the join costs, never what it finds. Shingles stand for themselves by
their 64-bit hash. Every link is confirmed by the two whole sets.

Only components are asked for, so pairs inside a cloud of near copies are not listed. First each set is
tried with a few leaders, the members of its prefix keys that share most; then pairs are sought only
between sets that are still in different components. Two sets whose overlap is o share at least
t = o - ceil(0.8 n) + k prefix keys (n of either, the lesser result), so a set that has c keys in common with
any sets of other components finds the similar ones by c - t + 1 of them, and takes those with the fewest
members: an edited copy that is near to nothing looks by its edits, not by what its whole cloud shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskloom.llm.shared import forget, map_arrays, materialize, new_folder, sheltered, slices, table, texts, write_arrays

DISTANCE, WIDTHS = 3, (10, 9, 9, 9, 9, 9, 9)
SHIFTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
#: Similarity as a fraction, the shingles whose frequency is held, one text in so many that is looked at for them; one shingle in so many that a candidate shares early.
SIMILAR, COMMON, SAMPLE, SHARE = (4, 5), 500_000, 16, 16
#: Leaders of a key, one from each part of the sets; steps of size in an octave, by which sets are sought.
LEADERS, STEPS = 4, 12
#: So many names are broadcast at most (8 MB); more are joined by a shuffle.
NAMES = 1 << 20
BUDGETS = tuple(DISTANCE * n // len(WIDTHS) for n in range(1, len(WIDTHS) + 1))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is set where over half the shingles' XXH64 (seed 42) have it; repeats count, no words give 0."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return 0
    grams = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))] or [b" ".join(words)]
    return _majority(np.array([xxh64_intdigest(g, 42) for g in grams], "<u8"))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bits of a long text by parts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def task(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, fp long")


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else (words,)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64))


def _node(hashes: np.ndarray) -> int:
    """The name of a set of shingles."""
    return int(np.array([xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)], np.uint64).view(np.int64)[0])


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """The rows of ``docs`` with the node of their text as ``__fp``."""

    def task(batches):
        for b in slices(batches):
            yield b.append_column("__fp", pa.array([_node(shingles(t, shingle)) for t in texts(b)], pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(task, f"{fields}, __fp long")


def _common(docs: DataFrame, shingle: int) -> str:
    """A file of the shingles that several different texts of a sample have, with the number of texts."""

    def task(batches):
        for b in slices(batches):
            for t in texts(b):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle).view(np.int64))], ["h"])

    sampled = docs.select(F.col("text").cast("string")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counted = sampled.mapInArrow(task, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    path = new_folder(docs.sparkSession, "common-shingles")
    write_arrays(path, {"h": h.view(np.uint64)[order], "n": n[order].astype(np.int64)})
    return path


def need(n: int) -> int:
    """How many shingles of its prefix a set of n must share (the smaller of two sets' numbers holds for a pair)."""
    return 1 + n // SHARE


def prefix(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the shingles by (count, hash), ``need`` of which every set as similar has among its own."""
    n, (up, down) = len(hashes), SIMILAR
    count = np.zeros(n, np.int64)
    if len(known) and n:
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        count = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, count))][: n - -(-up * n // down) + need(n) if n else 0]


def sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp (the name of the text's set of shingles), sim (the set's SimHash), n (its size) and prefix."""
    path = _common(docs, shingle)

    def task(batches):
        held = map_arrays(path)
        for b in slices(batches):
            rows = []
            for t in texts(b):
                h = shingles(t, shingle)
                sim = int(np.array([_majority(h) if len(h) else 0], np.uint64).view(np.int64)[0])
                rows.append((_node(h), sim, len(h), prefix(h, held["h"], held["n"]).view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "fp", "sim", "n", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, fp long, sim long, n long, prefix array<long>")


def _whole(docs: DataFrame, found: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(fp, hashes): the sets that ``asked(fp)`` names, made again from one text each rather than kept on disk for all."""
    ids = materialize(found.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("id")), "asked")
    few = ids.count() <= NAMES
    bounded = lambda df: F.broadcast(df) if few else df
    chosen = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string"))
    chosen = chosen.join(bounded(ids.select("id").distinct()), F.col("d").eqNullSafe(F.col("id")), "left_semi").select("text")

    def task(batches):
        for b in slices(batches):
            got = [shingles(t, shingle) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in got], pa.int64()), pa.array([h.view(np.int64) for h in got], pa.list_(pa.int64()))], ["fp", "hashes"])

    made = chosen.mapInArrow(task, "fp long, hashes array<long>")
    whole = materialize(made.join(bounded(ids.select("fp")), "fp", "left_semi"), "candidate-sets")
    return whole if whole.count() == ids.count() else whole.dropDuplicates(["fp"])  # a repeated doc_id has other texts too


def confirmed(docs: DataFrame, found: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is 0.8 or more."""
    up, down = SIMILAR
    pairs = materialize(pairs, "candidates")
    whole = _whole(docs, found, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), shingle)
    x, y = (whole.select(F.col("fp").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = F.size(F.array_intersect("ha", "hb"))  # i / (m + n - i) >= up / down, in whole numbers
    return pairs.join(x, "a").join(y, "b").where(both * (up + down) >= (F.size("ha") + F.size("hb")) * up).select("a", "b")


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _bit_links(nodes: DataFrame) -> DataFrame:
    """(a, b): for each SimHash its sets with the first of them, and the firsts of the SimHashes that are linked."""
    first = nodes.groupBy("sim").agg(F.min("fp").alias("first"))
    same = nodes.join(first, "sim").where("fp != first").select(*_ordered("fp", "first"))
    x, y = (first.select(F.col("sim").alias(c), F.col("first").alias(f"f{c}")) for c in "ab")
    near = links(first.select(F.col("sim").alias("fp"))).join(x, "a").join(y, "b")
    return same.unionByName(near.select(*_ordered("fa", "fb")))


def _least(n, m):
    """How many prefix keys two sets of n and m shingles share at the least if they are similar."""
    up, down = SIMILAR
    overlap = F.ceil((n + m) * up / (up + down))
    return F.least(*(overlap - F.ceil(x * up / down) + F.floor(x / SHARE) + 1 for x in (n, m)))


def _may_be(n, c, m, d):
    """Whether sets of n and m shingles, c and d of their prefix keys shared with any others, can be similar."""
    up, down = SIMILAR
    return (n * up <= m * down) & (m * up <= n * down) & (F.least(c, d) >= _least(n, m))


def _in_place(n, i, m, j):
    """Whether similar sets of n and m shingles can share the one at place i (from 0) of the first and j of the second.

    In the one order of all shingles, no more than least(i, j) common ones lie before it and no more than the shorter rest after it.
    """
    up, down = SIMILAR
    return F.least(i, j) + 1 + F.least(n - i, m - j) - 1 >= F.ceil((n + m) * up / (up + down))


def _by_leaders(keyed: DataFrame) -> DataFrame:
    """(a, b): each set with the leaders with which it shares most keys."""
    leader = F.struct("weight", "fp", "n", "c")
    heads = [F.max(F.when(F.pmod("fp", F.lit(LEADERS)) == i, leader)).alias(f"l{i}") for i in range(LEADERS)]
    met = keyed.join(keyed.groupBy("key").agg(*heads), "key").select("fp", "n", "c", F.explode(F.array(*(f"l{i}" for i in range(LEADERS)))).alias("l"))
    met = met.where((F.col("fp") != F.col("l.fp")) & _may_be(F.col("n"), F.col("c"), F.col("l.n"), F.col("l.c")))
    met = met.groupBy("fp", F.col("l.fp").alias("leader")).agg(F.count("*").alias("shared"))
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("shared"), "leader"))).where(F.col("rank") <= LEADERS)
    return best.select(*_ordered("fp", "leader"))


def _between(keyed: DataFrame, linked: DataFrame) -> DataFrame:
    """(a, b): the sets of ``keyed(key, fp, n, place)`` that are in different components (``linked(node, root)``) and can be similar.

    The set of the smaller component looks for the other. Of the keys at which it looks it needs only so many,
    those with the fewest members, that the others are fewer than what two similar sets share.
    """
    up, down = SIMILAR
    sizes = linked.groupBy("root").agg(F.count("*").alias("size"))
    own = linked.join(sizes, "root").select("node", F.struct("size", "root").alias("of"))
    rooted = keyed.join(own, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", "place", F.coalesce("of", F.struct(F.lit(1).cast("long").alias("size"), F.col("fp").alias("root"))).alias("of"))
    keys = rooted.groupBy("key").agg(F.max("of").alias("main"), F.min("of").alias("least"), F.count("*").alias("members")).where("main != least").drop("least")
    step = lambda n: F.floor(F.log2(n) * STEPS + 1e-9)
    open_ = materialize(rooted.join(keys, "key").withColumn("step", step(F.col("n"))), "open-keys")
    mine = Window.partitionBy("fp")
    looks = open_.where("of != main").withColumns({"c": F.count("*").over(mine), "rank": F.row_number().over(mine.orderBy("members", "key"))})
    low, high = F.ceil(F.col("n") * up / down), F.floor(F.col("n") * down / up)
    looks = looks.select("key", "fp", "n", "place", "of", "c", "rank", low.alias("low"), high.alias("high"), F.explode(F.sequence(step(low), step(high))).alias("step"))
    # ``_least`` rises and then falls with the size, but for roundings of less than three: over a range it is least at an end
    ends = [F.greatest("low", F.floor(F.pow(F.lit(2.0), F.col("step") / STEPS))), F.least("high", F.ceil(F.pow(F.lit(2.0), (F.col("step") + 1) / STEPS)))]
    least = F.when(ends[1] - ends[0] > 40, F.least(*(_least(F.col("n"), e) for e in ends)) - 3)
    least = F.greatest(F.lit(1), F.coalesce(least, F.array_min(F.transform(F.sequence(ends[0], F.greatest(*ends)), lambda m: _least(F.col("n"), m)))))
    looks = looks.where(F.col("rank") <= F.col("c") - least + 1)
    a, b = looks.alias("a"), open_.alias("b")
    may = _may_be(F.col("a.n"), F.col("a.c"), F.col("b.n"), F.col("a.c")) & _in_place(F.col("a.n"), F.col("a.place"), F.col("b.n"), F.col("b.place"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.of") < F.col("b.of")) & may)
    return met.select(*_ordered("a.fp", "b.fp")).distinct()


def weighed_keys(found: DataFrame) -> DataFrame:
    """(key, fp, n, place, c, weight): the prefix keys that several sets have; c is how many of them the set has, weight their members in all."""
    keyed = found.where("n > 0").select("fp", "n", "prefix").dropDuplicates(["fp"]).select("fp", "n", F.posexplode("prefix").alias("place", "key"))
    # counted where the rows lie: a join with the counts would hold prefixes and keys on disk a second time
    key, own = Window.partitionBy("key"), Window.partitionBy("fp")
    shared = keyed.withColumn("members", F.count("*").over(key)).where("members > 1")
    weighed = shared.withColumns({"c": F.count("*").over(own), "weight": F.sum("members").over(own)})
    return materialize(weighed.select("key", "fp", "n", "place", "c", "weight"), "weighed-keys")


def similar(docs: DataFrame, found: DataFrame, shingle: int = 5, keyed: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of sets of ``found`` (as of ``sets(docs)``) of similarity 0.8 or more, which reach whatever all such pairs reach.

    With ``keyed``, its ``weighed_keys``, ``found`` needs no prefixes.
    """
    keyed = weighed_keys(found) if keyed is None else keyed
    nodes = found.where("n > 0").select("fp", "sim").distinct()
    proposed = _by_leaders(keyed).unionByName(_bit_links(nodes)).distinct()
    near = materialize(confirmed(docs, found, proposed, shingle), "near")
    linked = materialize(components(near), "near-components")
    return near.unionByName(confirmed(docs, found, _between(keyed, linked), shingle))


def _segment(fp, i: int):
    i %= len(WIDTHS)
    return F.shiftrightunsigned(fp, SHIFTS[i]).bitwiseAND((1 << WIDTHS[i]) - 1)


def ring(x, start):
    """Whether every chain of segments from ``start`` has no more differing bits (set in ``x``) than its budget."""
    fits = F.lit(False)
    for first in range(len(WIDTHS)):
        total, chain = F.lit(0), F.lit(True)
        for n, budget in enumerate(BUDGETS):
            total = total + F.bit_count(_segment(x, first + n))
            chain = chain & (total <= budget)
        fits = F.when(start == first, chain).otherwise(fits)
    return fits


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints of ``nodes(fp)`` that differ in at most three bits."""
    fp, entries = F.col("fp"), []
    for start in range(len(WIDTHS)):
        for third in (2, 3):
            slot = start * 2 + third - 2
            key = F.lit(slot << 40) + _segment(fp, start) * (1 << 20) + _segment(fp, start + 1) * (1 << 10) + _segment(fp, start + third)
            entries.append(F.struct(F.lit(start).alias("start"), key.alias("key")))
    keyed = nodes.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.start", "e.key")
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & ring(x, F.col("a.start")) & (F.bit_count(x) <= DISTANCE))
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges(a, b)`` with the smallest node that it reaches.

    Alternating large and small stars: every round joins nodes' neighbours to the smallest one, until
    all edges are stars; rounds grow with the logarithm of the longest path. Each round is written to
    the shared folder. Only a count and a sum reach the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(low, "a")
        if large:
            moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = materialize(edges, "edges")
    seen = state(current)
    while seen[0]:
        current = materialize(star(star(current, True), False), "stars")
        now = state(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links of at most three bits)."""
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return _classes(marked, nodes, links(nodes))


def similar_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp, root, component_id (the smallest doc_id reachable by links of similarity 0.8 or more)."""
    whole = materialize(sets(docs, shingle), "sets")
    keyed, found = weighed_keys(whole), materialize(whole.drop("prefix"), "set-names")
    forget(whole)  # a third of what the texts take
    marked = found.select("doc_id", "fp")
    return _classes(marked, marked.groupBy("fp").agg(F.min("doc_id").alias("first")), similar(docs, found, shingle, keyed), "root")


def _classes(marked: DataFrame, nodes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """``marked(doc_id, fp)`` with the component of its fp, one of ``nodes(fp, first)``, under ``edges``."""
    linked = materialize(components(edges), "components")
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", *more, "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Rows of ``docs`` with one of each component of similar texts: the one with the smallest doc_id (null is the largest).

    Among rows that share that doc_id, the first set of the component decides, then the smallest hash of
    all columns; a row of another component stays, whatever its doc_id. Other columns are kept, whatever their names.
    """
    named, docs = docs.columns, sheltered(docs, ("doc_id", "text"))
    found = materialize(similar_groups(docs, shingle), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    kept = materialize(found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.fp").alias("__of")), "kept")
    often = found.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__o"))
    same, names = F.col("__id").eqNullSafe(F.col("__o")), docs.columns
    own = lambda df, on: df.join(on, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
    rows, several = own(docs, kept.join(often, same, "left_anti").select("__id")), kept.join(often, same, "left_semi")
    if several.limit(1).count():  # doc_ids of several rows: the row is told by its set
        found = _marked(own(docs, several.select("__id").distinct()), shingle).withColumn("__m", F.xxhash64(*names))
        found = found.join(several, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__of")), "left_semi")
        best = found.groupBy(F.col("doc_id").alias("__d"), F.col("__fp").alias("__f")).agg(F.min("__m").alias("__least"))
        found = found.join(best, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__fp") == F.col("__f")) & (F.col("__m") == F.col("__least")), "left_semi")
        rows = rows.unionByName(found.dropDuplicates(["doc_id", "__fp"]).select(*names))
    return rows.toDF(*named)


def op10_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}

"""Mixing sources to target weights: Pfair windows for source blocks, earliest deadline first.

A source with share a of Q (the sum of shares) has its k-th block released at slot floor(k Q / a) and
due by slot ceil((k + 1) Q / a). Of the blocks released, the one due first is taken (ties: the source
named first). Shares add up to the whole, so every block meets its deadline, and after any number of
slots each source is less than one block away from its share. All windows begin anew after Q slots,
so one frame of Q slots is the schedule: the frame is small, and every document finds its place in it
by arithmetic. When a source ends, a new frame of the remaining sources begins with their shares; no
row is dropped or repeated.

Weights are shares in whole numbers or fractions, exact where the frame they need has at most ``FRAME``
slots; beyond that they are rounded to so many parts, and an error says so if that alters one by more than
``TOLERANCE``. A source without a weight has the smallest one given. Null sources are the source ''. The
order inside a source is by MD5 of doc_id and text, then by doc_id and text: fixed, and free of any order
in the table; repeated rows stand side by side. Columns of the table are kept, but for any named block or
position in any case, which are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction
from heapq import heappop, heappush
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import sheltered, table

BLOCK, FRAME, TOLERANCE = 32, 1 << 20, 0.01
#: Sources are named on the driver and a schedule's row is a source and a stretch, so both are bounded; so many rows and slots are broadcast.
MAX_SOURCES, BROADCAST = 2000, 1 << 20


def shares(sources: list[str], weights: dict[str, float]) -> dict[str, int]:
    """Whole-number shares of the sources in lowest terms."""
    known = {s: Fraction(str(weights[s])) for s in sources if s in weights}
    if any(w <= 0 for w in known.values()):
        raise ValueError("weights must be positive")
    least = min(known.values(), default=Fraction(1))
    wanted = {s: known.get(s, least) for s in sources}
    unit = lcm(*(w.denominator for w in wanted.values()))
    common = gcd(*(int(w * unit) for w in wanted.values())) or 1
    exact = {s: int(w * unit) // common for s, w in wanted.items()}
    total = sum(exact.values())
    if total <= FRAME:
        return exact
    near = {s: max(1, round(Fraction(w * FRAME, total))) for s, w in exact.items()}
    for s, w in near.items():
        if abs(Fraction(w, sum(near.values())) * total / exact[s] - 1) > TOLERANCE:
            raise ValueError(f"a frame of {FRAME} slots has no share near enough to the weight of {s!r}")
    return near


def frame(share: dict[str, int]) -> list[str]:
    """The source of each of the Q slots, by earliest deadline among released blocks."""
    q, waiting, ready, out = sum(share.values()), [], [], []
    for s in share:
        heappush(waiting, (0, s, 0))
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heappop(waiting)
            heappush(ready, (-(-(k + 1) * q // share[s]), s, k))
        _, s, k = heappop(ready)
        out.append(s)
        if k + 1 < share[s]:
            heappush(waiting, ((k + 1) * q // share[s], s, k + 1))
    return out


def phases(blocks: dict[str, int], share: dict[str, int]) -> list[dict]:
    """Stretches of the schedule between the ends of sources: first slot, block of each source at its start, frame."""
    left, used, at, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    left = {s: n for s, n in left.items() if n}
    while left:
        slots = frame({s: share[s] for s in sorted(left)})
        places: dict[str, list[int]] = {}
        for i, s in enumerate(slots):
            places.setdefault(s, []).append(i)
        q = len(slots)
        ends = {s: (n - 1) // share[s] * q + places[s][(n - 1) % share[s]] for s, n in left.items()}
        length = min(ends.values()) + 1
        taken = {s: length // q * share[s] + bisect_left(places[s], length % q) for s in left}
        out.append({"at": at, "q": q, "from": {s: used[s] for s in left}, "taken": taken, "places": places})
        at += length
        for s, n in taken.items():
            used[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return out


def mix(docs: DataFrame, weights: dict[str, float], block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with ``block`` (of its source, from 0) and ``position`` (from 0, in blocks' order)."""
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("block", "position")]
    spark, named, docs = docs.sparkSession, [docs.columns[i] for i in kept], sheltered(docs, ("doc_id", "source", "text"))
    kept = [docs.columns[i] for i in kept]
    text = [F.xxhash64("text")] if "text" in docs.columns else []
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), *(t.cast("string") for t in text)))
    source = F.coalesce(F.col("source"), F.lit(""))
    # 4096 pieces of each source by the first digits of its order: a source of any size is numbered by many tasks
    keyed = docs.withColumns({"__source": source, "__order": order, "__piece": F.substring(order, 1, 3)})
    sizes = docs.select(source.alias("__source"), F.substring(order, 1, 3).alias("__piece")).groupBy("__source", "__piece").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("__source").orderBy("__piece")) - F.col("__rows")
    offsets = sizes.select(F.col("__source").alias("__os"), F.col("__piece").alias("__op"), before.alias("__before"))
    counted = {r[0]: r[1] for r in sizes.groupBy("__source").agg(F.sum("__rows")).limit(MAX_SOURCES + 1).collect()}
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to fewer before mixing")
    share = shares(sorted(counted), weights)
    plan = phases({s: -(-n // block) for s, n in counted.items()}, share)
    rows = [(s, p["from"][s], p["from"][s] + p["taken"][s], p["at"], p["q"], share[s], p["places"][s]) for p in plan for s in p["from"]]
    schedule = spark.createDataFrame(rows, "__ps string, __first long, __end long, __at long, __q long, __share long, __places array<long>")

    inside = Window.partitionBy("__source", "__piece").orderBy("__order", "doc_id", *text)
    numbered = keyed.withColumn("__rank", F.row_number().over(inside) - 1)
    # at most 4096 short rows a source: joined by key, broadcast if small
    placed = numbered.join(offsets, (F.col("__source") == F.col("__os")) & (F.col("__piece") == F.col("__op")))
    number = F.col("__before") + F.col("__rank")
    placed = placed.withColumns({"__block": F.floor(number / block), "__in": number % block})
    small = sum(len(r[6]) + 8 for r in rows) <= BROADCAST
    met = placed.join(F.broadcast(schedule) if small else schedule, (F.col("__source") == F.col("__ps")) & (F.col("__block") >= F.col("__first")) & (F.col("__block") < F.col("__end")))
    k = F.col("__block") - F.col("__first")
    slot = F.col("__at") + F.floor(k / F.col("__share")) * F.col("__q") + F.element_at("__places", (k % F.col("__share") + 1).cast("int"))
    return met.select(*kept, F.col("__block").cast("long").alias("block"), (slot * block + F.col("__in")).cast("long").alias("position")).toDF(*named, "block", "position")


def target_weights() -> dict[str, float]:
    """The mixture that the query and the pipeline ask for: the large source a quarter, some others raised."""
    return {"src0": 10, "src1": 4, "src2": 4, "src3": 2, "src4": 2} | {f"src{i}": 1 for i in range(5, 20)}


def op1_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, target_weights()).select("doc_id", "source", "block", "position")


QUERIES = {"op1_mix": op1_mix}
SQL: dict[str, str] = {}

"""Keystroke sequences: timings parsed, snapshots stitched to streams, windows and splits of identities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds that a key can be held and that can pass to the next; length and step of windows.
DWELL, FLIGHT, LENGTH, STEP = (1.0, 1000.0), (0.0, 5000.0), 20, 10
_PAIRS = "array<struct<dwell:double,flight:double>>"


def _sound(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["dwell"].between(*DWELL) & p["flight"].between(*FLIGHT))


def timings(nested: Column, flat: list[Column]) -> Column:
    """(dwell, flight) pairs of a row: of the JSON list where it has any that can be, else of the 'dwell;flight' columns."""
    listed = F.filter(F.from_json(nested, "array<array<double>>"), lambda p: F.size(p) == 2)
    listed = _sound(F.transform(F.coalesce(listed, F.array().cast("array<array<double>>")), lambda p: F.struct(p[0].alias("dwell"), p[1].alias("flight"))))
    parts = [F.split(F.trim(c), ";") for c in flat]
    cells = F.array(*[F.when(F.size(p) == 2, F.struct(F.get(p, F.lit(0)).try_cast("double").alias("dwell"), F.get(p, F.lit(1)).try_cast("double").alias("flight"))) for p in parts]) if flat else F.array().cast(_PAIRS)
    return F.when(F.size(listed) > 0, listed).otherwise(_sound(F.array_compact(cells)))


def changed(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows with pairs whose snapshot differs from the one before of the same identity, told by its figures to two places."""
    text = F.array_join(F.transform("pairs", lambda p: F.concat(F.format_string("%.2f", p["dwell"]), F.lit(":"), F.format_string("%.2f", p["flight"]))), ";")
    there = rows.where(F.size("pairs") > 0).withColumn("told", text)
    last = F.lag("told").over(Window.partitionBy(by).orderBy(order))
    return there.withColumn("last", last).where(~F.col("told").eqNullSafe(F.col("last"))).drop("told", "last")


def streams(rows: DataFrame, by: str, order: str, least: int = LENGTH) -> DataFrame:
    """(identity, dwell, flight): the snapshots of each identity joined where the end of its stream is the beginning of the next.

    One identity's own snapshots are one group: each adds only what lies beyond the longest overlap.
    """

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        stream: list[tuple[float, float]] = []
        group = group.sort_values(order)
        for dwell, flight in zip(group["dwell"], group["flight"]):
            new = list(zip(dwell.tolist(), flight.tolist()))
            shared = next((k for k in range(min(len(stream), len(new)), 0, -1) if stream[-k:] == new[:k]), 0)
            stream += new[shared:]
        kept = stream if len(stream) >= least else []
        return pd.DataFrame({"identity": [group[by].iloc[0]] if kept else [], "dwell": [[d for d, _ in kept]] if kept else [], "flight": [[f for _, f in kept]] if kept else []})

    figures = (F.transform("pairs", lambda p: p[c]).alias(c) for c in ("dwell", "flight"))  # lists of numbers cross to Python whole, structs one by one
    return changed(rows, by, order).select(by, order, *figures).groupBy(by).applyInPandas(stitch, "identity string, dwell array<double>, flight array<double>")


def windows(made: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(identity, start, dwell, flight): runs of ``length`` pairs, a new one every ``step``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("dwell") - length, F.lit(0)), F.lit(step))
    cut = made.where(F.size("dwell") >= length).select("*", F.explode(starts).alias("start"))
    return cut.select("identity", "start", *(F.slice(c, F.col("start") + 1, length).alias(c) for c in ("dwell", "flight")))


def _share(n: Column, hundredths: int) -> Column:
    """So many hundredths of a whole number, rounded down: in whole numbers, as 90,000 times 0.7 is less than 63,000 in doubles."""
    return F.floor(n * hundredths / 100)


def splits(identities: DataFrame) -> DataFrame:
    """``identities(identity)`` with label and split: 70, 15 and 15 hundredths in the order of names; a row an identity."""
    n = F.count("*").over(Window.partitionBy())
    label = F.row_number().over(Window.orderBy("identity")) - 1
    train, val = F.greatest(F.lit(1), _share(n, 70)), F.greatest(F.lit(1), _share(n, 15))
    return identities.select("identity", label.cast("long").alias("label"), F.when(label < train, "train").when(label < train + val, "val").otherwise("test").alias("split"))


def metrics(rows: DataFrame) -> DataFrame:
    """Rows with any of the core figures, each agent's figures once (the earliest)."""
    core = ["mean_dwell_time_ms", "mean_flight_time_ms", "typing_speed_cpm"]
    there = rows.dropna(how="all", subset=core)
    return there.groupBy("agent_id", *core).agg(F.min("timestamp").alias("timestamp"))


def verification(made: DataFrame, length: int = LENGTH, step: int = STEP, seed: int = 42) -> DataFrame:
    """(identity, kind, nth, source, start, dwell, flight): windows to enroll by, genuine probes, and as many impostors' probes.

    A stream is cut into its first six tenths and the rest before it is cut into windows, so no key is on both sides.
    An identity takes part if it has ``2 length + 4 step`` pairs and three windows on each side. Its impostors' probes are drawn
    by hash of seed, identity and number from the others' probes: the other by its place among the identities (a row an identity),
    the probe by its number, so a draw is a join on keys and the same wherever it runs.
    """
    n, cut = F.size("dwell"), _share(F.size("dwell"), 60).cast("int")
    part = lambda a, size: F.struct(*(F.slice(c, a, size).alias(c) for c in ("dwell", "flight")))
    whole = made.where(n >= 2 * length + 4 * step).select("identity", F.explode(F.array(
        F.struct(F.lit("enroll").alias("kind"), part(F.lit(1), cut).alias("s")), F.struct(F.lit("genuine").alias("kind"), part(cut + 1, n - cut).alias("s")))).alias("p"))
    rows = whole.select("identity", "p.kind", "p.s.dwell", "p.s.flight").withColumn("count", F.floor((F.size("dwell") - length) / step) + 1)
    fits = F.min("count").over(Window.partitionBy("identity")) >= 3
    rows = rows.withColumn("fits", fits).where("fits").drop("fits")
    cuts = rows.select("identity", "kind", "count", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("nth"), "dwell", "flight").withColumn("start", F.col("nth") * step)
    cuts = cuts.select("identity", "kind", "nth", F.col("identity").alias("source"), "start", *(F.slice(c, F.col("start") + 1, length).alias(c) for c in ("dwell", "flight")))
    probes = rows.where("kind = 'genuine'").select("identity", "count")
    of = probes.withColumn("place", F.row_number().over(Window.orderBy("identity")).cast("long") - 1)
    total = probes.agg(F.count("*").alias("total"))
    draw = lambda what: F.abs(F.xxhash64(F.lit(seed), F.lit(what), "identity", "nth"))
    wanted = of.join(F.broadcast(total)).where("total > 1").select("identity", "place", "total", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("nth"))
    other = F.expr("pmod(place + 1 + pmod(other, total - 1), total)")
    wanted = wanted.withColumn("other", draw("who")).select("identity", "nth", other.alias("place"), draw("which").alias("which"))
    drawn = wanted.join(of.select("place", F.col("identity").alias("source"), "count"), "place").select("identity", "nth", "source", F.expr("cast(pmod(which, count) as int)").alias("probe"))
    genuine = cuts.where("kind = 'genuine'").select("source", F.col("nth").alias("probe"), "start", "dwell", "flight")
    impostors = drawn.join(genuine, ["source", "probe"]).select("identity", F.lit("impostor").alias("kind"), "nth", "source", "start", "dwell", "flight")
    return cuts.unionByName(impostors)


def protocol(made: DataFrame, least: int = 4, length: int = LENGTH, seed: int = 42) -> DataFrame:
    """(identity, protocol, side, dwell, flight): what trains and what the verification is held out on.

    Of ``least`` identities or more, three tenths (two at least, two always left) in the order of a seeded hash are held out whole: open-set.
    Of fewer, each stream's first half trains and the rest is held out: temporal; halves shorter than a window go.
    """
    ranked = made.select("identity").withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "identity"), "identity")))
    n = F.count("*").over(Window.partitionBy())
    ranked = ranked.withColumn("n", n).withColumn("held", F.least(F.greatest(F.lit(2), _share(F.col("n"), 30)), F.col("n") - 2))
    rows = made.join(ranked, "identity")
    wide, half = F.col("n") >= least, F.floor(F.size("dwell") / 2).cast("int")
    side = F.when(F.col("place") > F.col("n") - F.col("held"), "bench").otherwise("train")
    piece = lambda name, a, size: F.struct(F.lit("temporal").alias("protocol"), name.alias("side"), *(F.slice(c, a, size).alias(c) for c in ("dwell", "flight")))
    whole = F.array(F.struct(F.lit("open-set").alias("protocol"), side.alias("side"), "dwell", "flight"))
    parts = F.array(piece(F.lit("train"), F.lit(1), half), piece(F.lit("bench"), half + 1, F.size("dwell") - half))
    out = rows.select("identity", "n", F.inline(F.when(wide, whole).otherwise(parts)))
    return out.where((F.col("protocol") == "open-set") | (F.size("dwell") >= length)).select("identity", "protocol", "side", "dwell", "flight")

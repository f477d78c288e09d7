"""Short-window authentication bursts and calibrated z-scores, as expressions inside a row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.rules import Features

#: Words that place a deviation in a domain, in order.
Z_DOMAINS = (
    ("logon", ("auth", "logon", "workstation", "pc", "session", "after_hours")),
    ("file", ("file", "filename", "delete", "sensitive")),
    ("network", ("http", "domain", "upload", "sent", "network", "sharing", "traffic")),
    ("device", ("usb", "device", "removable", "drive")),
)
EXPECTED = 2.0
#: Columns that ``auth_burst`` makes on its way, each from those before it: the plan holds each once.
_STEPS = ("ratio", "epm", "good", "failed", "total", "share")


def auth_burst(df: DataFrame, deviations: dict[str, Column] | None = None) -> DataFrame:
    """``auth``: score, confidence, pattern, failed and total of the last five minutes; the first case that holds counts.

    ``deviations``: how far the host's own values lie from its baseline; what lies within two is expected.
    """
    f, dev = Features(df), deviations or {}
    ratio, epm, good, failed, total, share = (F.col(f"__{c}") for c in _STEPS)
    stated = f.raw("edr_failed_auth_ratio_window", "auth_fail_rate_300s")
    attempts = f.raw("edr_auth_total_attempt_count_window", "auth_attempt_count_300s")
    inferred = F.when((ratio < 1) & good.isNotNull(), ratio * F.greatest(F.lit(0.0), good) / (1 - ratio)).when(ratio == 1, attempts)
    told = F.coalesce(f.raw("edr_failed_auth_event_count_window", "failed_auth_count_300s"), f.raw("edr_failed_auth_events_per_minute_window") * 5, inferred, F.lit(0.0))
    df = df.withColumns({"__ratio": F.when(stated.between(0, 1), stated), "__epm": f.raw("edr_auth_events_per_minute_window", "auth_rate_300s")})
    df = df.withColumn("__good", F.coalesce(f.raw("edr_auth_event_count_window"), F.when(epm.isNotNull(), F.greatest(F.lit(0.0), epm * 5))))
    df = df.withColumn("__failed", F.greatest(F.lit(0.0), told)).withColumn("__total", F.coalesce(good, F.lit(0.0)) + failed)
    df = df.withColumn("__share", F.coalesce(ratio, F.when(total > 0, failed / total)))
    hosts, rate = f.n("unique_workstations_300s"), F.coalesce(epm, F.lit(0.0))
    usual = lambda *names: F.coalesce(F.coalesce(*(dev.get(n, F.lit(None).cast("double")) for n in names)) < EXPECTED, F.lit(False))
    wide = ~usual("unique_workstations_300s")
    at_least = lambda x, y: F.coalesce(x >= y, F.lit(False))
    s0 = F.coalesce(share, F.lit(0.0))
    many = wide & (hosts >= 4) & (total >= 8)
    calm = usual("auth_rate_300s", "edr_auth_events_per_minute_window") & (s0 < 0.2)
    cases = [
        ((hosts >= 3) & (failed >= 4) & at_least(share, 0.5), 85.0, 0.90, F.lit("MULTI_WORKSTATION_BURST")),
        (at_least(share, 0.75) & (failed >= 5), 85.0, 0.90, F.lit("HIGH_FAILURE_BURST")),
        (wide & (hosts >= 3) & ((total >= 4) | (rate >= 1)) & ~at_least(share, 0.5), 75.0, 0.85, F.lit("MULTI_WORKSTATION_BURST")),
        ((failed >= 8) | many, 70.0, 0.82, F.when(many, "MULTI_WORKSTATION_BURST").otherwise("HIGH_FAILURE_BURST")),
        (~calm & (((rate >= 3) & (s0 >= 0.5)) | (rate >= 5)), 60.0, 0.75, F.lit("VELOCITY_BURST")),
        (~usual("off_hours_auth_count") & (f.n("off_hours_auth_count") >= 2) & (total >= 3), 35.0, 0.60, F.lit("OFF_HOURS_BURST")),
    ]
    pick = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("pattern"))
    for when, score, confidence, pattern in reversed(cases):
        pick = F.when(when, F.struct(F.lit(score).alias("score"), F.lit(confidence).alias("confidence"), pattern.alias("pattern"))).otherwise(pick)
    taken = [F.col(f"__pick.{c}").alias(c) for c in ("score", "confidence", "pattern")]
    out = df.withColumn("__pick", pick).withColumn("auth", F.struct(*taken, failed.alias("failed"), total.alias("total"), hosts.alias("workstations")))
    return out.drop("__pick", *(f"__{c}" for c in _STEPS))


def z_domain(name: str) -> str:
    return next((d for d, words in Z_DOMAINS if any(w in name.lower() for w in words)), "other")


def calibrated(z: Column, threshold: float = 8.0) -> Column:
    """A deviation on the scale of 0 to 100, in straight pieces."""
    top = max(7.0, threshold)
    points = [(2.0, 0.0), (3.0, 40.0), (5.0, 70.0), *([(7.0, 95.0), (top, 100.0)] if top > 7 else [(7.0, 100.0)])]
    out = F.lit(100.0)
    for (z0, y0), (z1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(z <= z1, y0 + (z - z0) / (z1 - z0) * (y1 - y0)).otherwise(out)
    return F.when(z <= 2.0, 0.0).otherwise(out)


def zscore(df: DataFrame, deviations: dict[str, Column], threshold: float = 8.0, velocity: Column | None = None) -> DataFrame:
    """``z``: score, confidence, greatest deviation, each domain's greatest, and the features that lie two or more above."""
    f, top, named = Features(df), max(7.0, threshold), list(deviations)
    rise = lambda c: F.coalesce(F.when(~F.isnan(c) & (c > 0), c).otherwise(0.0), F.lit(0.0))
    up = {n: F.col(f"__up_{i}") for i, n in enumerate(named)}
    speed, own, quick, k, score, greatest = (F.col(f"__{c}") for c in ("speed", "own", "quick", "k", "score", "greatest"))
    most = lambda cols: F.lit(0.0) if not cols else cols[0] if len(cols) == 1 else F.greatest(*cols)
    domain = {d: most([*(c for n, c in up.items() if z_domain(n) == d), *([speed] if d == "logon" else [])]) for d, _ in Z_DOMAINS}
    excess = [F.greatest(F.lit(0.0), F.col(f"__in_{d}") - 2.0) for d in domain]
    fast = (speed >= 4) & (f.n("auth_rate_300s") >= 2) & (f.n("unique_workstations_300s") >= 2)
    scaled = calibrated(speed, threshold)
    norm = F.sqrt(reduce(add, (e * e for e in excess)))
    compound = F.when(k >= 2, F.least(F.lit(100.0), norm * (100.0 / (top - 2.0)) * (1.0 + 0.15 * (k - 1)))).otherwise(0.0)
    shown = F.when(greatest > 0, greatest).when(quick > 0, speed).otherwise(0.0)
    confidence = F.when(score > 0, F.least(F.lit(0.95), 0.45 + 0.05 * shown + 0.08 * F.greatest(F.lit(0), k - 1))).otherwise(0.0)
    high = F.array_compact(F.array(*(F.when(c >= 2, F.lit(n)) for n, c in up.items())))
    before = df.columns
    df = df.withColumns({f"__up_{i}": rise(deviations[n]) for i, n in enumerate(named)} | {"__speed": F.greatest(F.lit(0.0), F.coalesce(velocity, F.lit(0.0))) if velocity is not None else F.lit(0.0)})
    df = df.withColumns({f"__in_{d}": c for d, c in domain.items()} | {"__most": most(list(up.values()))})
    df = df.withColumns({
        "__own": calibrated(F.col("__most"), threshold), "__quick": F.when(fast, F.least(F.lit(65.0), F.greatest(scaled, (speed - 2) * 12))).otherwise(scaled),
        "__k": reduce(add, ((e > 0).cast("int") for e in excess)),
    })
    df = df.withColumns({"__score": F.greatest(own, quick, compound), "__greatest": F.when(quick > own, speed).otherwise(F.col("__most"))})
    df = df.withColumns({"__told": F.round(score, 9), "__sure": F.round(confidence, 9), "__high": high})
    z = F.struct(F.col("__told").alias("score"), F.col("__sure").alias("confidence"), greatest.alias("max_z"), k.alias("domains"), *(F.col(f"__in_{d}").alias(d) for d in domain), F.col("__high").alias("features"))
    return df.withColumn("z", z).drop(*(c for c in df.columns if c not in before))

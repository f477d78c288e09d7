"""Training of the host model: inputs, out-of-fold scores of blocks of days, the forecast fitted on them, cut-offs chosen over all values.

A fold fits forests and trees on the days up to a cut and scores the days after it, so no score comes from a model that has seen its day.
The forecast is fitted on windows of seven normal days and a normal eighth inside one block: none crosses a cut.

A class that the fitted days don't show has no trees and a probability of zero, the normal one too. Without normal days nothing is known of anomalies
(risk, peak, and what is made of them are null), without normal weeks nothing of the forecast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import daily as D
from riskloom.operators import models as M
from riskloom.sources.files import shared_folder

#: The classes, the normal one first, and the features that the mixed representation takes relative to their past.
CLASSES = ("BENIGN", "CLOUD_EXFILTRATION_PRECURSOR", "CREDENTIAL_DUMP", "DATA_HOARDING", "IT_SABOTAGE", "USB_EXFILTRATION_PRECURSOR", "HONEYTOKEN_TRIP", "KILL_CHAIN_APT")
RELATIVE = (
    "successful_logons", "failed_logons", "unique_pc_count", "interactive_duration_seconds", "usb_connect_count", "distinct_usb_devices", "file_access_count", "new_filename_count", "http_request_count",
    "new_domain_count", "mean_process_count", "bytes_sent", "bytes_received", "external_connection_count", "clipboard_copy_count", "named_pipe_event_count",
)
#: The greatest share of normal rows above a cut-off, the cut that nothing reaches.
FALSE_ALARMS, NEVER = 0.03, 1.000001
REPRESENTATIONS = ("level", "context", "hybrid")
DOMAINS = {d: [D.FEATURES[i] for i in n] for d, n in D.DOMAINS.items()}
_KEY = ["hostname", "review_date"]


def calibration(host: str = "hostname"):
    """The fifth of the hosts against which anomalies are placed, by the hash of their name."""
    return F.conv(F.substring(F.sha2(host, 256), 1, 8), 16, 10).cast("long") % 5 == 0


def placed(days: DataFrame, fit: DataFrame, trees: int = M.TREES) -> DataFrame:
    """``days`` with each domain's anomaly, ``risk`` and ``peak``: forests of the normal rows of ``fit``, placed among its calibration hosts' normal rows."""
    normal = fit.where("label = 'BENIGN'")
    models = M.fit_forests(normal.where(~calibration()), DOMAINS, _KEY, trees)
    reference = M.score_forests(normal.where(calibration()), models, DOMAINS, _KEY).withColumn("__own", F.lit(True))
    scored = M.score_forests(days, models, DOMAINS, _KEY).withColumn("__own", F.lit(False))
    out = M.upper_tenth(scored.unionByName(reference), F.col("__own"), list(DOMAINS)).where(~F.col("__own")).drop("__own")
    return days.join(out, _KEY)


def inputs(days: DataFrame, representation: str = "level") -> tuple[DataFrame, list[str]]:
    """``days`` (with anomalies) and the forty inputs of the trees: 32 features, four anomalies, risk and its past.

    ``level``: log1p of the features; ``context``: how far each lies from the host's last week; ``hybrid``: that for ``RELATIVE`` ones.
    """
    if representation not in REPRESENTATIONS:
        raise ValueError(f"no representation {representation!r}")
    days = D.runs(days)
    log = {f: F.log1p(F.col(f).cast("double")) for f in D.KEPT}
    far = [f for f in D.KEPT if representation == "context" or (representation == "hybrid" and f in RELATIVE)]
    days = days.withColumns({f"in_{f}": c for f, c in log.items()})
    days = days.withColumns({f"in_{f}": D.against_past(F.col(f"in_{f}")) for f in far}) if far else days
    mean, std = D.past(F.col("risk"))
    days = days.withColumns({"past7_risk_mean": mean, "past7_risk_std": std})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    days = days.withColumns({"risk_minus_past7_mean": F.coalesce(F.col("risk") - F.col("past7_risk_mean"), F.lit(0.0)), "past7_risk_mean": zero("past7_risk_mean"), "past7_risk_std": zero("past7_risk_std")})
    return days.drop("run"), [*(f"in_{f}" for f in D.KEPT), *DOMAINS, "risk", "past7_risk_mean", "past7_risk_std", "risk_minus_past7_mean"]


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/training-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def known_classes(rows: DataFrame, classes) -> list[str]:
    """Those of ``classes`` that have rows, in their order."""
    there = {r[0] for r in rows.select("label").distinct().collect()}
    return [c for c in classes if c in there]


def fold(days: DataFrame, fit, target, spec: B.Spec, seeds: tuple[int, ...], representation: str = "level", trees: int = M.TREES, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(hostname, review_date, label, threat, risk, peak) of the days where ``target`` holds, by models of those where ``fit`` holds.

    ``days``: hostname, review_date, label and the forty features, all known.
    """
    made, names = inputs(placed(days, days.where(fit), trees), representation)
    made = _kept(made, "inputs")
    known, kept = known_classes(made.where(fit), classes), [*_KEY, "label", "risk", "peak"]
    if not known:  # no day to learn from
        return made.where(target).select(*kept[:3], F.lit(None).cast("double").alias("threat"), *kept[3:])
    models = [B.fit(made.where(fit), names, "label", _KEY, spec, known, seed) for seed in seeds]
    said = B.probabilities(made.where(target), models, kept)
    normal = F.col(f"p_{classes[0]}") if classes[0] in known else F.lit(0.0)
    return said.select(*_KEY, "label", (1 - normal).alias("threat"), "risk", "peak")


def chronological(days: DataFrame, cuts: list[int], spec: B.Spec, number: str = "day_index", seed: int = M.SEED, trees: int = M.TREES, classes: tuple[str, ...] = CLASSES) -> tuple[DataFrame, list]:
    """(hostname, review_date, block, label, threat, risk, fused, forecast, error) of the days after the first cut, and the forecast's ridges.

    ``cuts``: each block runs from one to the next, the last to the end; a block is scored by models of all days up to its beginning.
    ``forecast`` and ``error`` (how far fused lies above it) where the block holds the seven days before.
    """
    if cuts != sorted(set(cuts)) or not cuts:
        raise ValueError("cuts must rise")
    day = F.col(number)
    parts = []
    for n, low in enumerate(cuts):
        high = cuts[n + 1] if n + 1 < len(cuts) else None
        target = (day > low) if high is None else (day > low) & (day <= high)
        part = fold(days, day <= low, target, spec, (seed,), trees=trees, classes=classes)
        parts.append(part.withColumn("block", F.lit(n)))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = _kept(scored.withColumn("fused", D.fuse(F.col("threat"), F.col("risk"), F.col("peak"))["weighted15"]).drop("peak"), "folds")
    # a block's days are runs of their own, so that no window crosses a cut
    windows = None
    for n in range(len(cuts)):
        own = D.runs(scored.where(F.col("block") == n)).withColumn("__normal", F.min((F.col("label") == classes[0]).cast("int")).over(Window.partitionBy("hostname", "run").orderBy("review_date").rowsBetween(-M.DAYS, 0)))
        own = D.sequences(own, "fused").select(*_KEY, "fused", "history", (F.col("__normal") == 1).alias("normal"))
        windows = own if windows is None else windows.unionByName(own)
    windows = _kept(windows, "windows")
    model = M.fit_forecast(windows.where("normal"), "fused")
    said = M.forecast(windows, model, _KEY).withColumn("forecast", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("forecast"))))
    out = scored.join(said, _KEY, "left")
    return out.withColumn("error", F.when(F.col("forecast").isNotNull(), F.greatest(F.col("fused") - F.col("forecast"), F.lit(0.0)))), model


# -- cut-offs -------------------------------------------------------------------------------------


def sweep(scored: DataFrame, cohorts: list[str]) -> DataFrame:
    """(cut, tp_<cohort>, fp_<cohort>, pos_<cohort>, neg_<cohort>...) for every score that occurs as the cut-off ``score >= cut``, and for ``NEVER``.

    ``scored``: cohort, positive (boolean), score; without a score (null, NaN) a row is left out. Equal scores are counted first; ranges of scores are then
    dealt to tasks, each range's totals are added up (a row a range), and a range's own running sums begin from those of the ranges above it.
    """
    spark = scored.sparkSession
    rows = scored.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("cohort").isin(cohorts))
    hit = lambda c, p: F.count_if((F.col("cohort") == c) & (F.col("positive") == p))
    sums = {f"{kind}_{c}": hit(c, p) for c in cohorts for kind, p in (("tp", True), ("fp", False))}
    each = rows.groupBy(F.col("score").alias("cut")).agg(*(v.alias(k) for k, v in sums.items()))
    never = spark.createDataFrame([(NEVER, *([0] * len(sums)))], "cut double, " + ", ".join(f"`{k}` long" for k in sums))
    dealt = _kept(each.unionByName(never).repartitionByRange(F.desc("cut")).withColumn("part", F.spark_partition_id()), "cuts")
    whole = dealt.groupBy("part").agg(*(F.sum(k).alias(f"all_{k}") for k in sums))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of scores
    before = whole.select("part", *(F.coalesce(F.sum(f"all_{k}").over(above), F.lit(0)).alias(f"before_{k}") for k in sums))
    total = whole.agg(*(F.sum(f"all_{k}").alias(f"{'pos' if k[:2] == 'tp' else 'neg'}_{k[3:]}") for k in sums))
    inside = Window.partitionBy("part").orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(F.broadcast(before), "part").select("cut", *((F.sum(k).over(inside) + F.col(f"before_{k}")).alias(k) for k in sums))
    return run.join(F.broadcast(total))  # one row


def measured(cuts: DataFrame, cohorts: list[str]) -> DataFrame:
    """``cuts`` with ``worst`` and ``mean`` balanced accuracy over the cohorts and ``alarms``, the greatest share of normal rows above the cut."""
    part = lambda k, n, c: F.col(f"{k}_{c}") / F.nullif(F.col(f"{n}_{c}"), F.lit(0))
    balanced = [0.5 * (part("tp", "pos", c) + 1 - part("fp", "neg", c)) for c in cohorts]
    alarms = [part("fp", "neg", c) for c in cohorts]
    least = lambda xs: xs[0] if len(xs) == 1 else F.least(*xs)
    most = lambda xs: xs[0] if len(xs) == 1 else F.greatest(*xs)
    mean = balanced[0]
    for b in balanced[1:]:
        mean = mean + b
    return cuts.withColumns({"worst": least(balanced), "mean": mean / len(cohorts), "alarms": most(alarms)})


def cut_off(scored: DataFrame, cohorts: list[str], most: float = FALSE_ALARMS) -> float:
    """Of the cut-offs that no cohort's normal rows pass by more than ``most``, the one of the best worst cohort, then the best mean, then the highest."""
    return best_cut(measured(sweep(scored, cohorts), cohorts), most)


def best_cut(cuts: DataFrame, most: float = FALSE_ALARMS) -> float:
    """``cut_off`` of cut-offs that are measured already."""
    best = cuts.where(F.col("alarms") <= most).agg(F.max(F.struct("worst", "mean", "cut")).alias("b")).first().b
    return float(best.cut)


# -- behaviour heads ------------------------------------------------------------------------------


def heads(made: DataFrame, names: list[str], behaviours: dict[str, str], calibrating, spec: B.Spec, keep: list[str], seed: int = M.SEED, most: float = FALSE_ALARMS) -> tuple[DataFrame, dict[str, float | None]]:
    """(keep, behaviour, probability, label, status) of every row and behaviour, and each behaviour's cut-off.

    ``made``: ``keep`` and the inputs ``names``; ``behaviours``: a condition each that says which rows show it. Each has two-class trees of its own, fitted on the rows that
    don't calibrate; its cut-off is chosen over the scores of those that do (one cohort). Where no cut-off under ``most`` false alarms finds anything, or
    either side has no row, there is none: the head abstains, with its probability if it has one, and labels nothing.
    """
    parts, cuts = [], {}
    for name, rule in behaviours.items():
        rows = made.withColumn("__shows", F.when(F.coalesce(F.expr(rule), F.lit(False)), "yes").otherwise("no")).withColumn("__calibrates", F.coalesce(calibrating, F.lit(False)))
        sides = {(r[0], r[1]) for r in rows.select("__calibrates", "__shows").distinct().collect()}
        cuts[name] = None
        if {(False, "yes"), (False, "no")} <= sides:
            model = B.fit(rows.where(~F.col("__calibrates")), names, "__shows", keep, spec, ["no", "yes"], seed)
            said = _kept(B.probabilities(rows, [model], [*keep, "__shows", "__calibrates"]).withColumnRenamed("p_yes", "probability"), "head")
            if {(True, "yes"), (True, "no")} <= sides:
                scored = said.where("__calibrates").select(F.lit("all").alias("cohort"), (F.col("__shows") == "yes").alias("positive"), F.col("probability").alias("score"))
                cut = cut_off(scored, ["all"], most)
                cuts[name] = None if cut == NEVER else cut
        else:
            said = rows.withColumn("probability", F.lit(None).cast("double"))
        cut = cuts[name]
        label = F.lit(False) if cut is None else F.coalesce(F.col("probability") >= cut, F.lit(False))
        status = "abstain_calibration_unmet" if cut is None else "calibrated_threshold_applied"
        parts.append(said.select(*keep, F.lit(name).alias("behaviour"), "probability", label.alias("label"), F.lit(status).alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, cuts

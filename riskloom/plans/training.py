"""Training of the host model over host-days: folds, cut-offs, attributions, behaviour heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import daily as D
from riskloom.operators import training as T
from riskloom.plans import daily
from riskloom.plans.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: What a host-day is said to be, by its own features: the rules that stand for analysts' labels here.
RULES = {
    "HONEYTOKEN_TRIP": "decoy_access_count > 0", "KILL_CHAIN_APT": "lsass_handle_request_count + memory_dump_attempt_count > 0 and file_sharing_visit_count > 0", "CREDENTIAL_DUMP": "lsass_handle_request_count + memory_dump_attempt_count > 0",
    "CLOUD_EXFILTRATION_PRECURSOR": "file_sharing_visit_count > 0", "USB_EXFILTRATION_PRECURSOR": "usb_connect_count >= 3", "IT_SABOTAGE": "file_delete_count >= 2", "DATA_HOARDING": "new_filename_count >= 4",
}
#: Smaller than the host model's own settings, so that the queries end in seconds on small tables: ``boosting.Spec()`` has those.
QUICK = B.Spec(rounds=3, child=2.0, ridge=4.0, lasso=0.1, gain=0.05, rate=0.2)
CUTS, TREES = [14, 22], 30


def labelled(spark, sf_dir):
    """Host-days whose forty features are all known, with label and day of the month."""
    label = F.lit("BENIGN")
    for name, rule in reversed(RULES.items()):
        label = F.when(F.expr(rule), name).otherwise(label)
    # a feature is null where its sensor slept, and only there: forty conditions on derived columns would be forty copies of their derivation
    days = daily.host_days(spark, sf_dir).where(F.size("missing_sensors") == 0)
    return days.select("hostname", "review_date", F.col("d").alias("day_index"), "threat", "s", label.alias("label"), *D.FEATURES)


def _classes(days):
    """The classes that the first fold knows, the normal one first."""
    there = {r.label for r in days.where(F.col("day_index") <= CUTS[0]).select("label").distinct().collect()}
    return tuple(c for c in T.CLASSES if c in there or c == "BENIGN")


@R.query("host_model_folds")
def host_model_folds(spark, sf_dir):
    """Each block of days scored by forests and trees of the days before it, and the forecast fitted on those scores' normal weeks."""
    days = T._kept(labelled(spark, sf_dir), "days")
    out, _ = T.chronological(days, CUTS, QUICK, trees=TREES, classes=_classes(days))
    return out.select("hostname", "review_date", "block", "label", *(F.round(c, 6).alias(c) for c in ("threat", "risk", "fused", "forecast", "error")))


@R.query("host_model_attributions")
def host_model_attributions(spark, sf_dir):
    """Of each host's most threatening day what every input adds to the margin of its label, by two models' exact attributions."""
    days = T._kept(labelled(spark, sf_dir), "days")
    own = days.where(F.col("label").isin(*_classes(days)))
    classes = T.known_classes(own, T.CLASSES)
    made, names = T.inputs(T.placed(own, days, TREES))
    made = T._kept(made, "inputs")
    if not classes:
        return made.select("hostname", "review_date", "label", F.lit("").alias("feature"), F.lit(0.0).alias("contribution")).where("false")
    models = [B.fit(made, names, "label", ["hostname", "review_date"], QUICK, classes, seed) for seed in (20_261_021, 20_261_022)]
    said = B.probabilities(made, models, ["hostname", "review_date", "label"])
    normal = F.col("p_BENIGN") if "BENIGN" in classes else F.lit(0.0)
    day = F.max_by(F.struct("review_date"), F.struct(-normal, "review_date"))
    top = said.groupBy("hostname").agg(day.alias("x")).select("hostname", "x.review_date")
    told = B.explain(made.join(top, ["hostname", "review_date"], "left_semi"), models, ["hostname", "review_date", "label"])
    return told.where("class = label").select("hostname", "review_date", "label", "feature", F.round("contribution", 6).alias("contribution"))


_TRUE = "s % 7 = 0"
_CUTS = daily._WITH + f""", r as (select case when d % 2 = 0 then 'even' else 'odd' end as cohort, ({_TRUE})::int as p, threat as score from hd), c as (select distinct score as cut from r union select {T.NEVER}),
w as (select cut, {', '.join(f"(select count(*) from r where cohort = '{c}' and p = {p} and score >= cut) as {k}_{c}" for c in ('even', 'odd') for k, p in (('tp', 1), ('fp', 0)))},
  {', '.join(f"(select count(*) from r where cohort = '{c}' and p = {p}) as {k}_{c}" for c in ('even', 'odd') for k, p in (('pos', 1), ('neg', 0)))} from c)"""


def _scored(spark, sf_dir):
    days = daily.host_days(spark, sf_dir)
    return days.select(F.when(F.col("d") % 2 == 0, "even").otherwise("odd").alias("cohort"), F.expr(_TRUE).alias("positive"), F.col("threat").alias("score"))


@R.query("cutoff_sweep", _CUTS + " select * from w")
def cutoff_sweep(spark, sf_dir):
    """What every score that occurs would let through as the cut-off, by cohort."""
    return T.sweep(_scored(spark, sf_dir), ["even", "odd"])


_BA = {c: f"0.5 * (tp_{c} / pos_{c} + 1 - fp_{c} / neg_{c})" for c in ("even", "odd")}


@R.query("cutoff_choice", _CUTS + f""" select cut, round(least({_BA['even']}, {_BA['odd']}), 6) as worst, round(greatest(fp_even / neg_even, fp_odd / neg_odd), 6) as alarms from w
  where greatest(fp_even / neg_even, fp_odd / neg_odd) <= {T.FALSE_ALARMS} qualify row_number() over (order by least({_BA['even']}, {_BA['odd']}) desc, ({_BA['even']} + {_BA['odd']}) / 2 desc, cut desc) = 1""")
def cutoff_choice(spark, sf_dir):
    """The cut-off that at most three percent of each cohort's normal days pass and that serves the worst cohort best."""
    # swept once: the choice and its figures are read from what is written
    cuts = T._kept(T.measured(T.sweep(_scored(spark, sf_dir), ["even", "odd"]), ["even", "odd"]).select("cut", "worst", "mean", "alarms"), "measured")
    return cuts.where(F.col("cut") == T.best_cut(cuts)).select("cut", F.round("worst", 6).alias("worst"), F.round("alarms", 6).alias("alarms"))


#: What each head looks for: the rules that stand for analysts' labels here.
BEHAVIOURS = {
    "CREDENTIAL_DUMP": "lsass_handle_request_count + memory_dump_attempt_count > 0", "USB_EXFILTRATION_PRECURSOR": "usb_connect_count >= 3", "IT_SABOTAGE": "file_delete_count >= 2", "CLOUD_EXFILTRATION_PRECURSOR": "file_sharing_visit_count > 0",
    "DATA_HOARDING": "new_filename_count >= 4", "HONEYTOKEN_TRIP": "decoy_access_count > 0", "RECON": "dns_query_count >= 12", "STAGING": "file_access_count >= 5 and usb_connect_count > 0",
}


@R.query("host_model_heads")
def host_model_heads(spark, sf_dir):
    """Each behaviour's probability of every host-day, its label by a calibrated cut-off, or that it abstains."""
    days = T._kept(labelled(spark, sf_dir), "days")
    made, names = T.inputs(T.placed(days, days, TREES))
    out, _ = T.heads(T._kept(made, "inputs"), names, BEHAVIOURS, T.calibration(), B.Spec(rounds=2, child=2.0, ridge=4.0, lasso=0.1, gain=0.05, rate=0.5), ["hostname", "review_date"])
    return out.select("hostname", "review_date", "behaviour", F.round("probability", 6).alias("probability"), "label", "status")

"""Detectors into one score: certainty-gated ensemble, history, scenarios, stages, kill chain, guard.

History is the four hours before a snapshot, of the same user and agent: one shuffle by these, and a
range frame over time. In batch the history's scores are the ensemble's own, before smoothing.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.planned import planned
from riskloom.operators.rules import CHANGES, TRANSFERS, UPLOADS, Features

#: Weights of detectors, floors of scenarios' severities.
WEIGHTS = {"ml": 0.70, "z": 0.10, "auth": 0.05, "rules": 0.15}
FLOORS = {"LOW": 0.0, "MEDIUM": 40.0, "HIGH": 70.0, "CRITICAL": 90.0}
#: Thresholds of the host model, and its eight classes' number.
THREAT, DRIFT, CLASSES = 0.5247461037635804, 0.37640477627357144, 8
BEFORE = "interval '0 04:00:00.000000' day to second preceding and interval '0 00:00:00.000001' day to second preceding"
STAGES = ("CREDENTIAL_ACCESS", "LATERAL_MOVEMENT", "EXECUTION_PERSISTENCE", "COLLECTION_STAGING", "EXFILTRATION_SABOTAGE")


def prior_detector(priors: DataFrame, day: Column) -> DataFrame:
    """``ml`` of each agent from its nightly prior, null where that is of another day, too young or out of range."""
    inside = reduce(lambda a, b: a & b, (F.col(c).between(0, 1) & ~F.isnan(c) for c in ("threat_probability", "fused_risk", "drift_error", "pair_threat")))
    ok = (F.col("as_of") == day) & (F.col("history_days") >= 22) & inside & (F.col("classes") == CLASSES)
    ml = F.struct((F.col("threat_probability") * 100).alias("score"), F.lit(0.85).alias("confidence"), ((F.col("threat_probability") >= THREAT) | (F.col("drift_error") >= DRIFT)).alias("is_anomaly"))
    return priors.select("agent_id", F.when(F.coalesce(ok, F.lit(False)), ml).alias("ml"))


def ensemble(df: DataFrame) -> DataFrame:
    """``raw_score`` of rules, z, auth and, where there is one, ml; a detector without confidence has no weight."""
    fired = F.size("detections") > 0
    parts = {
        "rules": (F.col("rule_score"), F.when(fired, 0.9).otherwise(0.0)), "z": (F.col("z.score"), F.col("z.confidence")), "auth": (F.col("auth.score"), F.col("auth.confidence")),
        "ml": (F.coalesce(F.col("ml.score"), F.lit(0.0)), F.when(F.col("ml").isNotNull(), F.greatest(F.lit(0.75), F.col("ml.confidence"))).otherwise(0.0)),
    }

    def weight(name):
        s, c = parts[name]
        boost = F.when(s >= 40, 1.0 + 2.0 * ((s - 40.0) / 60.0) * ((s - 40.0) / 60.0) * c).otherwise(1.0)
        return F.when(c > 0, WEIGHTS[name] * boost).otherwise(0.0)

    weighed = df.withColumns({f"__w_{n}": weight(n) for n in parts})
    total = reduce(add, (F.col(f"__w_{n}") for n in parts))
    value = reduce(add, (parts[n][0] * F.col(f"__w_{n}") for n in parts))
    score = F.greatest(F.when(total > 0, value / total).otherwise(0.0), F.col("rule_score"))
    return weighed.withColumn("raw_score", score).drop(*(f"__w_{n}" for n in parts))


def over_history(what: str, keys: str = "username, agent_id", ts: str = "ts") -> Column:
    """An aggregate over the four hours strictly before a row."""
    return F.expr(f"{what} over (partition by {keys} order by {ts} range between {BEFORE})")


def smoothed(df: DataFrame) -> DataFrame:
    df = df.withColumn("past_max", F.coalesce(over_history("max(raw_score)"), F.lit(0.0)))
    mixed = 0.85 * F.col("raw_score") + 0.15 * F.least(F.lit(100.0), F.col("past_max"))
    return df.withColumn("smooth_score", F.when(F.col("past_max") > 0, F.greatest("raw_score", mixed)).otherwise(F.col("raw_score")))


def _ids() -> Column:
    return F.transform("detections", lambda d: d["scenario_id"])


def _z_names(*parts: str) -> Column:
    return F.exists("z.features", lambda n: n.rlike("|".join(parts)))


def scenarios(df: DataFrame) -> DataFrame:
    """``cert``: the scenarios that the evidence bears out, with their severities."""
    f = Features(df)
    has = lambda i: F.array_contains(_ids(), i)
    deleted = f.most("daily_file_delete_count", "file_delete_count")
    change = reduce(lambda a, b: a | b, ((f.n(c) > 0) | f.flag(c) for c in CHANGES))
    auth = (F.col("auth.score") >= 60) | ((F.col("z.score") >= 60) & _z_names("auth"))
    s1 = has("S1") | ((deleted >= 10) & change) | (change & ((f.n("after_hours_logon") >= 2) | has("S1_PRECURSOR") | auth))
    wide = f.most("daily_unique_filename_count", "sensitive_file_access", "daily_new_filename_count") >= 100
    s2 = has("S2") | ((F.col("z.score") >= 35) & _z_names("file", "filename", "sensitive")) | wide
    moved, upload = f.most(*TRANSFERS, "large_usb_transfer") > 0, f.most(*UPLOADS) > 0
    s4 = upload & ((f.n("sensitive_file_access") > 0) | s2)
    table = [
        ("HONEYTOKEN", "CRITICAL", f.flag("threat_triggered")), ("S1_CRED_DUMP", "CRITICAL", f.flag("credential_dumping_suspected")),
        ("S1_INJECTION", "HIGH", (f.n("unbacked_executable_regions") > 0) | f.flag("threats_detected")),
        ("NETWORK_TUNNELING", "HIGH", (f.n("tunneling_process_count") > 0) | f.flag("tunneling_detected")),
        ("S1", "HIGH", s1), ("S1_PRECURSOR", "LOW", ~s1 & (deleted >= 20)), ("S2", "MEDIUM", s2), ("S3", "HIGH", moved),
        ("S3_PRECURSOR", "LOW", ~moved & (f.most("usb_connect_count", "daily_device_connect_count") > 0)), ("S4", "HIGH", s4),
        ("S4_PRECURSOR", "LOW", ~s4 & (upload | (f.n("file_sharing_site_visits") > 0))),
    ]
    one = lambda i, s: F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"))
    return df.withColumn("cert", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), one(i, s)) for i, s, c in table))))


def stages(df: DataFrame) -> DataFrame:
    """``stages`` of this snapshot, and ``kept_stages``: those that its stored signals alone bear out later."""
    f = Features(df)
    every = F.array_union(_ids(), F.transform("cert", lambda c: c["id"]))
    has = lambda *ids: F.arrays_overlap(every, F.array(*map(F.lit, ids)))
    pattern = F.coalesce(F.col("auth.pattern"), F.lit(""))
    many = f.n("unique_workstations_300s") >= 3
    signs = {
        "CREDENTIAL_ACCESS": has("S1_CRED_DUMP", "HONEYTOKEN") | pattern.isin("HIGH_FAILURE_BURST", "VELOCITY_BURST") | (F.col("z.logon") >= 3),
        "LATERAL_MOVEMENT": (pattern == "MULTI_WORKSTATION_BURST") | many,
        "EXECUTION_PERSISTENCE": has("S1_INJECTION"), "COLLECTION_STAGING": has("S2", "S1_PRECURSOR") | (F.col("z.file") >= 3),
        "EXFILTRATION_SABOTAGE": has("S1", "S3", "S4", "NETWORK_TUNNELING") | (F.col("z.network") >= 3.5) | (F.col("z.device") >= 3.5),
    }
    raw = {
        "EXECUTION_PERSISTENCE": f.flag("modifications_detected") | f.flag("threats_detected") | (f.most(*CHANGES, "unbacked_executable_regions") > 0),
        "COLLECTION_STAGING": f.most("sensitive_file_access", "file_sharing_site_visits") > 0,
        "EXFILTRATION_SABOTAGE": f.flag("tunneling_detected") | (f.most("tunneling_process_count", "daily_files_to_removable_count", "usb_file_transfer_count", "cloud_upload_bytes", "large_usb_transfer") > 0),
    }
    pack = lambda tests: F.array_compact(F.array(*(F.when(F.coalesce(tests[s], F.lit(False)), F.lit(s)) for s in STAGES)))
    return df.withColumns({"stages": pack({s: c | raw[s] if s in raw else c for s, c in signs.items()}), "kept_stages": pack(signs)})


def kill_chain(df: DataFrame) -> DataFrame:
    """``chain_floor``: an earlier stage and a new one, two kinds or more, within four hours."""
    seen = [F.when(over_history(f"max(array_contains(kept_stages, '{s}'))"), F.lit(s)) for s in STAGES]  # five flags over one frame
    df = df.withColumn("past_stages", F.array_compact(F.array(*seen)))
    new, union = F.size(F.array_except("stages", "past_stages")), F.size(F.array_union("stages", "past_stages"))
    moves = (F.size("past_stages") > 0) & (new > 0) & (union >= 2)
    return df.withColumn("chain_floor", F.when(moves & (union >= 3), 95.0).when(moves, 85.0).otherwise(0.0))


def corroborated() -> Column:
    """Whether one of seven tests bears a high score out."""
    ml, ml_c = F.coalesce(F.col("ml.score"), F.lit(0.0)), F.when(F.col("ml").isNotNull(), 0.85).otherwise(0.75)
    rules, z = F.col("rule_score"), F.col("z.score")
    return (
        ((ml >= 75) & (ml_c >= 0.8) & ((rules >= 10) | (z >= 25) | (F.size("cert") > 0))) | ((rules >= 60) & (F.size("domains") >= 2)) | ((ml >= 85) & (ml_c >= 0.85))
        | ((F.col("auth.score") >= 85) & (F.col("auth.confidence") >= 0.85)) | ((z >= 85) & (F.col("z.confidence") >= 0.85))
        | F.exists("cert", lambda c: c["severity"].isin("CRITICAL", "HIGH")) | (F.col("chain_floor") > 0)
    )


@planned
def fuse(df: DataFrame) -> DataFrame:
    """``risk_score`` and ``risk_level`` from a frame that rules, signals and ``ml`` have been added to."""
    df = kill_chain(stages(scenarios(smoothed(ensemble(df)))))
    floor = F.coalesce(F.array_max(F.transform("cert", lambda c: F.when(c["severity"] == "CRITICAL", 90.0).when(c["severity"] == "HIGH", 70.0).when(c["severity"] == "MEDIUM", 40.0).otherwise(0.0))), F.lit(0.0))
    df = df.withColumn("__score", F.greatest("smooth_score", floor, "chain_floor"))
    score = F.col("__score")
    df = df.withColumn("guarded", (score >= 70) & ~corroborated())
    df = df.withColumn("risk_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(F.col("guarded"), F.least(score, F.lit(10.0))).otherwise(score))), 9))
    final = F.col("risk_score")
    level = F.when(final >= 90, "critical").when(final >= 70, "high").when(final >= 40, "medium").otherwise("low")
    said = F.concat_ws(" | ", F.when(F.size("detections") > 0, F.concat(F.lit("Heuristics: "), F.array_join(F.transform("detections", lambda d: d["scenario"]), " | "))), F.array_join(F.transform("cert", lambda c: c["id"]), " | "))
    return df.withColumns({"risk_level": level, "summary": F.when(said == "", "Normal behavior.").otherwise(said)}).drop("__score")

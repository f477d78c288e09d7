"""Host-days: admission, calendar, gap-free history, sequences, evidence of fifteen days, review queues, drift, metrics.

A host has one row a day at most, so every window here is a host's (or a gap-free run of its) days:
small groups, dealt by host. Missing days are never filled with zeros: they abstain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The forty features of a host-day, in their order.
FEATURES = (
    "successful_logons", "failed_logons", "after_hours_logon_ratio", "unique_pc_count", "pc_access_entropy", "interactive_duration_seconds", "mean_session_duration_seconds", "weekend_activity",
    "usb_connect_count", "usb_disconnect_count", "after_hours_usb_ratio", "distinct_usb_devices", "file_access_count", "unique_filename_count", "new_filename_count", "file_delete_count",
    "file_access_entropy", "protected_file_touch_count", "http_request_count", "unique_domain_count", "new_domain_count", "external_domain_ratio", "domain_access_entropy", "file_sharing_visit_count",
    "mean_process_count", "peak_process_count", "admin_process_count", "temp_exec_count", "bytes_sent", "bytes_received", "external_connection_count", "unique_remote_ip_count",
    "clipboard_copy_count", "lsass_handle_request_count", "memory_dump_attempt_count", "decoy_access_count", "wmi_query_count", "named_pipe_event_count", "dns_query_count", "outbound_attachment_count",
)
#: Features that the model leaves out, shares, and counts that are part of other counts.
OMITTED = (
    "mean_session_duration_seconds", "usb_disconnect_count", "unique_filename_count", "unique_domain_count", "peak_process_count", "unique_remote_ip_count", "wmi_query_count", "dns_query_count",
)
SHARES = ("after_hours_logon_ratio", "after_hours_usb_ratio", "external_domain_ratio")
PARTS = {
    "unique_pc_count": "successful_logons", "new_filename_count": "unique_filename_count", "unique_filename_count": "file_access_count", "file_delete_count": "file_access_count",
    "new_domain_count": "unique_domain_count", "unique_domain_count": "http_request_count", "file_sharing_visit_count": "http_request_count", "unique_remote_ip_count": "external_connection_count",
}
#: Attestations, the contract, kinds of sources, and the domains' features by number.
ATTESTED = ("observation_complete", "feature_contract_verified", "sensor_coverage_verified", "timezone_verified")
CONTRACT, OBSERVED = "v3_daily40_observed_v1", ("observed_unlabeled", "observed_labeled")
DOMAINS = {
    "identity": range(8), "device_file": range(8, 18), "web_network": (*range(18, 24), *range(28, 32), 38, 39), "execution": (*range(24, 28), *range(32, 38)),
}
#: Cut-offs of the review policy.
PAIR_CUTOFF, THREAT_CUTOFF, DRIFT_CUTOFF = 0.41032636165618896, 0.5247461037635804, 0.37640477627357144
KEPT = tuple(f for f in FEATURES if f not in OMITTED)
METHODS = ("v2_error", "second_error", "pair_error", "pair_threat", "pair_agreement", "top3_error", "persistent_error_mix", "agreement_peak_pair")


def admit(days: DataFrame) -> DataFrame:
    """``days`` with status, what is missing (names in order, comma-joined) and what is wrong in a complete day's values."""
    said = [F.when(F.col(f).isNull(), F.lit(f)) for f in FEATURES]
    said += [F.when(F.col("journal_gap_detected"), F.lit("sensor:usn_journal_gap"))]
    said += [F.when(~F.coalesce(F.col(f).cast("double") == 1, F.lit(False)), F.lit(f)) for f in ATTESTED]
    said += [F.when(~F.col("feature_contract_version").eqNullSafe(CONTRACT), F.lit("feature_contract_version")), F.when(~F.coalesce(F.col("source_kind").isin(*OBSERVED), F.lit(False)), F.lit("source_kind"))]
    sensors = F.transform(F.coalesce("missing_sensors", F.array().cast("array<string>")), lambda s: F.concat(F.lit("sensor:"), s))
    missing = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*said)), sensors)))
    bad = [F.when(~(F.col(f) >= 0) | F.isnan(f) | (F.col(f) == float("inf")), F.lit(f"nonfinite or negative {f}")) for f in FEATURES]
    bad += [F.when(F.col(f) > 1, F.lit(f"ratio exceeds 1: {f}")) for f in SHARES]
    bad += [F.when(~F.col("weekend_activity").isin(0.0, 1.0), F.lit("weekend_activity must be 0 or 1")), F.when(F.col("interactive_duration_seconds") > 86400, F.lit("interactive duration exceeds one day"))]
    bad += [F.when(F.col(part) > F.col(whole) + 1e-7, F.lit(f"{part} exceeds {whole}")) for part, whole in PARTS.items()]
    errors = F.when(F.size(missing) == 0, F.array_join(F.array_compact(F.array(*bad)), ",")).otherwise("")
    status = F.when(F.size(missing) > 0, "abstain_missing_sensors").when(errors != "", "rejected").otherwise("complete")
    return days.withColumns({"status": status, "missing": F.array_join(missing, ","), "errors": errors})


def every_day(admitted: DataFrame, as_of: str, days: int = 22) -> DataFrame:
    """agent_id, hostname, review_date, status for each known agent and each of the last days; without a row: abstain_missing_day."""
    last = F.lit(as_of).cast("date")
    there = admitted.where(F.col("review_date").between(F.date_sub(last, days - 1), last)).select("agent_id", "hostname", "review_date", "status")
    agents = there.groupBy("agent_id").agg(F.max_by("hostname", "review_date").alias("hostname"))
    spine = agents.select("agent_id", "hostname", F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("review_date"))
    return spine.join(there.select("agent_id", "review_date", "status"), ["agent_id", "review_date"], "left").select("agent_id", "hostname", "review_date", F.coalesce("status", F.lit("abstain_missing_day")).alias("status"))


def runs(days: DataFrame, host: str = "hostname", day: str = "review_date") -> DataFrame:
    """``days`` with ``run``: equal for the days of a host that follow each other without a gap."""
    return days.withColumn("run", F.date_sub(day, F.row_number().over(Window.partitionBy(host).orderBy(day))))


def complete_days(admitted: DataFrame, as_of: str) -> DataFrame:
    """(agent_id, days): how many complete days end at ``as_of``, back to the first gap; agents with any complete day."""
    marked = runs(admitted.where("status = 'complete'").select("agent_id", "review_date").distinct(), "agent_id")
    count = marked.groupBy("agent_id", "run").agg(F.count("*").alias("n"), F.max("review_date").alias("last"))
    return count.groupBy("agent_id").agg(F.coalesce(F.max(F.when(F.col("last") == F.lit(as_of).cast("date"), F.col("n"))), F.lit(0)).cast("long").alias("days"))


def before(order: str = "review_date", days: int = 7):
    return Window.partitionBy("hostname", "run").orderBy(order).rowsBetween(-days, -1)


def past(value, least: int = 3):
    """Mean and sample deviation of up to seven days before, inside a run; null with fewer than ``least``."""
    w = before()
    enough = F.count(value).over(w) >= least
    return F.when(enough, F.avg(value).over(w)), F.when(enough, F.stddev_samp(value).over(w))


def against_past(value) -> Column:
    """How far a value is from its past in deviations of a quarter or more, between -8 and 8; 0 without a past."""
    mean, std = past(value)
    far = (value - mean) / F.greatest(std, F.lit(0.25))
    return F.when(far.isNotNull(), F.greatest(F.lit(-8.0), F.least(F.lit(8.0), far))).otherwise(0.0)


def sequences(days: DataFrame, value: str) -> DataFrame:
    """Rows with seven days without a gap before them, all with a value: those values, oldest first, as ``history``."""
    w = before()
    found = days.withColumn("history", F.collect_list(value).over(w))
    return found.where((F.size("history") == 7) & F.col(value).isNotNull())


def fuse(threat, mean, peak) -> dict[str, Column]:
    usual = threat * 0.85 + mean * 0.15
    return {"weighted15": usual, "weighted35": threat * 0.65 + mean * 0.35, "novelty": F.greatest(usual, peak * 0.5), "reference": F.greatest(mean, mean * 0.3 + threat * 0.7)}


def evidence(daily: DataFrame, as_of: str, days: int = 15) -> DataFrame:
    """A row a host over the ``days`` days to ``as_of``: coverage, the eight measures (null unless eligible) and the places of their pairs.

    ``daily``: hostname, review_date, error, threat, risk, complete. All of it is a short array of the host's own days.
    """
    last = F.lit(as_of).cast("date")
    inside = F.col("review_date").between(F.date_sub(last, days - 1), last)
    day = F.struct("review_date", F.col("error").alias("e"), F.col("threat").alias("p"), F.col("risk").alias("r"), F.col("complete").alias("c"))
    host = daily.groupBy("hostname").agg(F.array_sort(F.collect_list(F.when(inside, day))).alias("w"))
    whole = F.size("w") == days  # a host has a day once
    known = ~F.exists("w", lambda x: x["e"].isNull() | x["p"].isNull() | x["r"].isNull())
    status = F.when(~whole, "insufficient_contiguous_history").when(~known, "forecast_or_input_unavailable").when(F.exists("w", lambda x: ~x["c"]), "incomplete_observation").otherwise("complete_15_target_days")
    host = host.withColumn("coverage_status", status).withColumn("eligible", F.col("coverage_status") == "complete_15_target_days")
    e, p = F.transform("w", lambda x: x["e"]), F.transform("w", lambda x: x["p"])
    host = host.withColumns({"e": e, "p": p, "a": F.transform("w", lambda x: F.sqrt(x["e"] * x["p"]))})
    pair = lambda c: F.zip_with(F.slice(c, 1, days - 1), F.slice(c, 2, days - 1), lambda x, y: F.least(x, y))
    host = host.withColumns({"ee": pair("e"), "pp": pair("p"), "aa": pair("a"), "s": F.sort_array("e", asc=False)})
    mean = lambda c, n: F.aggregate(c, F.lit(0.0), lambda t, x: t + x) / n
    top3, peak = mean(F.slice("s", 1, 3), 3), F.array_max("e")
    measures = {
        "v2_error": peak * mean(F.col("e"), days) * days**0.5, "second_error": F.get("s", F.lit(1)), "pair_error": F.array_max("ee"), "pair_threat": F.array_max("pp"), "pair_agreement": F.array_max("aa"),
        "top3_error": top3, "persistent_error_mix": F.array_max("ee") * 0.5 + top3 * 0.5, "agreement_peak_pair": F.sqrt(F.array_max("a") * F.array_max("aa")),
    }
    first = lambda c: F.array_position(c, F.array_max(c)).cast("int")
    places = {"error_at": first("ee"), "threat_at": first("pp"), "agreement_at": first("aa"), "agreement_peak_at": first("a"), "peak_at": first("e")}
    kept = {k: F.when(F.col("eligible"), v) for k, v in (measures | places).items()}
    return host.select("hostname", F.size("w").alias("observed_days"), "coverage_status", "eligible", *(v.alias(k) for k, v in kept.items()), F.transform("w", lambda x: x["review_date"]).alias("dates"), "e", "p")


def evidence_dates(found: DataFrame, method: str) -> Column:
    """The dates that support a method's measure, comma-joined in order."""
    highest = lambda n: F.slice(F.reverse(F.array_sort(F.transform("e", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))))), 1, n)
    both = lambda c: F.array(F.col(c), F.col(c) + 1)
    at = {
        "pair_error": both("error_at"), "persistent_error_mix": both("error_at"), "pair_threat": both("threat_at"), "pair_agreement": both("agreement_at"),
        "agreement_peak_pair": F.array_union(both("agreement_at"), F.array("agreement_peak_at")), "second_error": F.transform(highest(2), lambda x: x["i"]), "top3_error": F.transform(highest(3), lambda x: x["i"]),
    }.get(method, F.array("peak_at"))
    return F.when(F.col("eligible"), F.array_join(F.transform(F.array_sort(at), lambda i: F.element_at("dates", i).cast("string")), ",")).otherwise("")


def ranked(found: DataFrame, *order) -> DataFrame:
    """``found`` with ``rank`` from 1: a row a host, so one ordered list is small; taken after the hosts' own work."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def routed(found: DataFrame, cutoff: float = PAIR_CUTOFF, novelty_cutoff: float | None = None) -> DataFrame:
    """``found(hostname, eligible, pair_threat, novelty_score)`` with its route, order and score."""
    primary = F.col("eligible") & (F.col("pair_threat") >= cutoff)
    novel = F.col("eligible") & (F.col("novelty_score") >= novelty_cutoff) if novelty_cutoff is not None else F.lit(False)
    primary, novel = F.coalesce(primary, F.lit(False)), F.coalesce(novel, F.lit(False))
    route = F.when(primary, "supervised_persistence").when(novel, "anomaly_without_class_confirmation").otherwise("below_cutoff")
    return found.withColumns({"review_route": route, "route_order": F.when(primary, 0).when(novel, 1).otherwise(2), "route_score": F.when(primary, F.col("pair_threat")).otherwise(F.col("novelty_score"))})


def accepted(ranking: DataFrame, threshold: float | None, most: int = 20, enabled: bool = True) -> DataFrame:
    """``ranking(rank, eligible, evidence_score)`` with ``selection_status``: the first ``most`` of those above the threshold are reviewed."""
    if most < 1:
        raise ValueError("a review budget must be positive")
    over = F.coalesce(F.col("eligible") & (F.col("evidence_score") >= threshold), F.lit(False)) if enabled and threshold is not None else F.lit(False)
    marked = ranking.withColumn("over", over)
    place = F.sum(F.col("over").cast("int")).over(Window.orderBy("rank"))
    below = "abstain_below_evidence_threshold" if enabled else "abstain_calibration_target_unmet"
    status = F.when(F.col("over"), F.when(place <= most, "review_candidate").otherwise("deferred_review_budget")).when(F.col("eligible"), below).otherwise("abstain_incomplete_history")
    return marked.withColumn("selection_status", status).drop("over")


def confusion(scored: DataFrame, actual, said, *by: str) -> DataFrame:
    """Counts of right and wrong calls and what is made of them, null where a divisor is zero."""
    n = lambda c: F.count_if(c).alias
    out = scored.groupBy(*by).agg(n(actual & said)("tp"), n(~actual & said)("fp"), n(actual & ~said)("fn"), n(~actual & ~said)("tn"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn"), "false_rate": share("fp", "tn"), "balanced": (share("tp", "fn") + share("tn", "fp")) / 2})


def stability(rows: DataFrame, value: str, edges: list[float], expected: list[float]) -> Column:
    """The population stability index of the counts between ``edges`` against ``expected`` shares, as an aggregate."""
    total, part = F.count(value) + 1e-6 * len(expected), 0
    for i, share in enumerate(expected):
        above = F.col(value) >= edges[i - 1] if i else F.lit(True)
        below = F.col(value) < edges[i] if i < len(edges) else F.lit(True)
        seen = (F.count_if(above & below) + 1e-6) / total
        part = part + (seen - share) * F.log(seen / share)
    return part


#: What an analyst can say of a row of the queue.
TRIAGE = ("needs_investigation", "benign_context", "confirmed_incident", "acknowledged_suppressed")


def triage(queue: DataFrame, said: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """(queue with the analysts' words put in, audit): ``queue`` as_of, agent_id, analyst_status and others; ``said`` as_of, agent_id, status, note, actor, nth.

    Words on rows that the queue doesn't have change nothing. Of several on one row each is audited, with the status that it found
    (``nth`` tells their order), and the last stays. A status that is none ends the job. ``at``: when it was said.
    """
    checked = F.when(F.col("status").isin(*TRIAGE), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no analyst status: "), F.coalesce("status", F.lit("null")))))
    words = said.select("as_of", "agent_id", checked.alias("status"), "note", "actor", "nth")
    key, held = ["as_of", "agent_id"], queue.select("as_of", "agent_id", F.col("analyst_status").alias("__before"))
    before = F.lag("status").over(Window.partitionBy(*key).orderBy("nth"))  # a row of the queue has a few words
    audit = words.withColumn("__lag", before).join(held, key).select(*key, F.coalesce("__lag", "__before").alias("previous_status"), F.col("status").alias("new_status"), F.col("note").alias("analyst_note"), F.col("actor").alias("reviewed_by"), F.lit(at).alias("reviewed_at"), "nth")
    last = words.groupBy(*key).agg(F.max_by(F.struct("status", "note", "actor"), "nth").alias("__last"))
    out = queue.join(last, key, "left")
    heard = F.col("__last").isNotNull()
    more = {"analyst_status": F.when(heard, F.col("__last.status")).otherwise(F.col("analyst_status")), "analyst_note": F.col("__last.note"), "reviewed_by": F.col("__last.actor"), "reviewed_at": F.when(heard, F.lit(at))}
    return out.withColumns(more).drop("__last"), audit

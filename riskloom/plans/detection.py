"""Rules, signals and fusion over snapshots' features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.identity import truthy
from riskloom.functions.planned import planned
from riskloom.operators import fusion as U
from riskloom.operators import rules as D
from riskloom.operators import signals as S
from riskloom.plans.registry import Registry
from riskloom.sources.views import features, observations, with_sql

R = Registry()
QUERIES, SQL = R.queries, R.sql
#: Mean and deviation of a user's features before there is a baseline.
PRIORS = {"daily_unique_filename_count": (25.0, 35.0), "daily_new_filename_count": (10.0, 25.0), "file_access_count": (30.0, 50.0), "file_sharing_site_visits": (0.0, 0.5), "usb_connect_count": (0.0, 0.5)}


def _priors(spark, sf_dir):
    obs = observations(spark, sf_dir).groupBy("agent_id", F.to_date("ts").alias("as_of")).agg(F.sum("k").alias("s"), F.count("*").alias("n"))
    part = lambda m: (F.col("s") % m) / 100.0
    return obs.select(
        "agent_id", "as_of", F.when(F.col("n") % 3 == 0, 20).otherwise(25).alias("history_days"), part(104).alias("threat_probability"), part(80).alias("fused_risk"),
        part(50).alias("drift_error"), part(60).alias("pair_threat"), F.when(F.col("n") % 7 == 0, 7).otherwise(8).alias("classes"),
    )


def _dev():
    return {n: (F.col(n) - m) / s for n, (m, s) in PRIORS.items()}


@planned
def _told(df):
    return S.zscore(S.auth_burst(D.evaluate(df)), _dev())


def _signals(spark, sf_dir):
    return _told(features(spark, sf_dir))


planned_burst = planned(S.auth_burst)
planned_z = planned(lambda df: S.zscore(df, _dev()))


@planned
def _against(df):
    own = {c.removeprefix("z_"): F.col(c) for c in df.columns if c.startswith("z_")}
    host = {c.removeprefix("host_z_"): F.col(c) for c in df.columns if c.startswith("host_z_")}
    return S.zscore(S.auth_burst(df, host), own)


#: What the rules say of features; the same whatever has been learnt.
ruled = planned(D.evaluate)


#: From which deviation on ``scored_against`` feels a user's and a host's, and from which on no more: z-scores begin at 2 and end at 8, the confidence in
#: them at 10; of a host's only "below 2" is asked.
FELT = {"user": (S.EXPECTED, 10.0), "host": (S.EXPECTED, S.EXPECTED)}


def scored_against(df):
    """Features with what the rules say (``ruled``) and deviations ``z_<feature>`` and ``host_z_<feature>`` as risk_score, risk_level, ``burst`` and ``sure``."""
    seen = _against(df)
    fused = U.fuse(seen.withColumn("ml", F.lit(None).cast("struct<score:double,confidence:double,is_anomaly:boolean>")))
    sure = truthy(F.col("credential_dumping_suspected")) | truthy(F.col("threat_triggered"))
    return fused.select(*df.columns, "risk_score", "risk_level", (F.col("auth.score") > 0).alias("burst"), F.coalesce(sure, F.lit(False)).alias("sure"))


def _fused(spark, sf_dir):
    """A day's prior is that of the day before."""
    keyed = _priors(spark, sf_dir).withColumn("agent_id", F.struct("agent_id", F.date_add("as_of", 1).alias("day")))
    ml = U.prior_detector(keyed, F.col("as_of")).select("agent_id.agent_id", "agent_id.day", "ml")
    return U.fuse(_signals(spark, sf_dir).withColumn("day", F.to_date("ts")).join(ml, ["agent_id", "day"], "left"))


# -- the oracle's own form: one row for each detection ---------------------------------------------

_RULES = [
    ("After-Hours Logon Anomaly", "S1_PRECURSOR", "40", 0.7, "after_hours_logon >= 2 and daily_after_hours_logon_ratio >= 0.5 and successful_logons >= 3"),
    ("Multi-PC Access Anomaly", "AUTH_LATERAL", "40", 0.7, "daily_unique_pc_count >= 3 and successful_logons >= 3"),
    ("Failed Authentication Activity", "AUTH_BURST", "45", 0.7, "failed_logons >= 5 and edr_failed_auth_ratio_window >= 0.5"),
    ("Bulk File Collection", "S2", "75", 0.9, "file_access_count >= 500 and daily_unique_filename_count >= 100"),
    ("Broad File Collection", "S2", "45", 0.7, "not (file_access_count >= 500 and daily_unique_filename_count >= 100) and daily_unique_filename_count >= 50 and daily_new_filename_count >= 25"),
    ("Sensitive File Collection", "S2", "70", 0.9, "sensitive_file_access > 0 and (file_access_count >= 50 or daily_unique_filename_count >= 20)"),
    ("Mass File Deletion", "FILE_DELETE", "50", 0.7, "file_delete_count >= 10"),
    ("File Transfer to Removable Media", "S3", "80", 0.9, "daily_files_to_removable_count + usb_file_transfer_count > 0"),
    ("Cloud Upload Correlated with File Collection", "S4", "80", 0.9, "cloud_storage_uploads > 0 and (sensitive_file_access > 0 or greatest(daily_unique_filename_count, daily_new_filename_count) >= 50)"),
    ("Cloud Upload Without File Correlation", "S4_PRECURSOR", "25", 0.7, "cloud_storage_uploads > 0 and not (sensitive_file_access > 0 or greatest(daily_unique_filename_count, daily_new_filename_count) >= 50)"),
    ("File-Sharing Site Visit", "S4_PRECURSOR", "10", 0.4, "cloud_storage_uploads <= 0 and file_sharing_site_visits > 0"),
    ("Bulk USB File Transfer", "S3", "case when moved >= 20 then 80 else 60 end", 0.9, "moved > 0"),
    ("Unapproved USB Device", "S3_PRECURSOR", "40", 0.7, "moved <= 0 and unauthorized_usb_detected"),
    ("USB Device Activity", "S3_PRECURSOR", "10", 0.4, "moved <= 0 and not unauthorized_usb_detected and usb_connect_count > 0"),
    ("LSASS Credential Dumping Suspected", "S1_CRED_DUMP", "100", 0.95, "credential_dumping_suspected"),
    ("Unbacked Executable Memory", "S1_INJECTION", "85", 0.9, "unbacked_executable_regions > 0"),
    ("Network Tunneling Indicator", "NETWORK_TUNNELING", "80", 0.9, "tunneling_process_count > 0 or tunneling_detected"),
    ("Honeytoken Access", "HONEYTOKEN", "100", 0.95, "threat_triggered"),
    ("After-Hours Persistence Tampering", "S1", "85", 0.9, "modifications_detected and (after_hours_logon >= 2 or (edr_failed_auth_ratio_window >= 0.8 and coalesce(edr_failed_auth_events_per_minute_window, 0) * 5 >= 5))"),
]
#: Domain and group of each of these, as the oracle's own table.
_PLACES = {
    "After-Hours Logon Anomaly": ("LOGON", "LOGON_TIME_GROUP"), "Multi-PC Access Anomaly": ("LOGON", "LOGON_ASSET_GROUP"), "Failed Authentication Activity": ("LOGON", "LOGON_AUTH_GROUP"),
    "Bulk File Collection": ("FILE", "FILE_EXFIL_GROUP"), "Broad File Collection": ("FILE", "FILE_EXFIL_GROUP"), "Sensitive File Collection": ("FILE", "FILE_EXFIL_GROUP"), "Mass File Deletion": ("FILE", "FILE_SABOTAGE_GROUP"),
    "File Transfer to Removable Media": ("FILE", "DEVICE_USB_GROUP"), "Cloud Upload Correlated with File Collection": ("HTTP", "HTTP_EXFIL_GROUP"), "Cloud Upload Without File Correlation": ("HTTP", "GROUP_Cloud Upload Without File Correlation"),
    "File-Sharing Site Visit": ("HTTP", "HTTP_PRECURSOR_GROUP"), "Bulk USB File Transfer": ("FILE", "DEVICE_USB_GROUP"), "Unapproved USB Device": ("DEVICE", "DEVICE_USB_GROUP"), "USB Device Activity": ("DEVICE", "GROUP_USB Device Activity"),
    "LSASS Credential Dumping Suspected": ("CREDENTIAL", "GROUP_LSASS Credential Dumping Suspected"), "Unbacked Executable Memory": ("EXECUTION", "GROUP_Unbacked Executable Memory"),
    "Network Tunneling Indicator": ("HTTP", "GROUP_Network Tunneling Indicator"), "Honeytoken Access": ("DECEPTION", "HONEYTOKEN_GROUP"), "After-Hours Persistence Tampering": ("FILE", "SABOTAGE_GROUP"),
}
_SENS = {"FILE": (0.35, 0.6, 0.8), "HTTP": (0.6, 0.7, 0.8), "LOGON": (0.7, 0.3, 0.8), "DEVICE": (0.8, 0.7, 0.8)}


def _arm(pos: int) -> str:
    scenario, sid, score, conf, when = _RULES[pos]
    domain, group = _PLACES[scenario]
    dev, adm, rest = _SENS.get(domain, (1.0, 1.0, 1.0))
    trust = {"FILE": 0.2}.get(domain, 0.5 if group == "HTTP_EXFIL_GROUP" else 1.0)
    return (
        f"select payload_id, {pos} as pos, '{scenario}' as scenario, '{sid}' as sid, '{domain}' as domain, '{group}' as grp, ({score})::double * (case when process_name = 'git.exe' then {trust} else 1.0 end "
        f"* case when target_path like '%node_modules%' then 0.25 else 1.0 end) * case system_profile when 'DEVELOPER' then {dev} when 'SYSADMIN' then {adm} else {rest} end as eff, {conf} as conf from fx where {when}"
    )


_W = ", ".join(f"max(score) filter (domain = '{d}') as p_{d}" for d in D.DOMAINS)
_K = " + ".join(f"(p_{d} is not null)::int" for d in D.DOMAINS)
_V = " + ".join(f"coalesce(p_{d} * {w}, 0)" for d, w in D.DOMAINS.items())
_T = " + ".join(f"case when p_{d} is not null then {w} else 0 end" for d, w in D.DOMAINS.items())
_CTES = f"""{with_sql('feats')}, fx as (select *, greatest(daily_files_to_removable_count, usb_file_transfer_count) as moved from feats),
det as ({' union all '.join(_arm(i) for i in range(len(_RULES)))}),
grp as (select payload_id, grp, arg_max(domain, (w, -pos)) as domain, arg_max(scenario, (w, -pos)) as top, least(100.0, sum(w * pow(0.2, rn - 1))) as score, count(*)::int as n
  from (select *, eff * conf as w, row_number() over (partition by payload_id, grp order by eff * conf desc, pos) as rn from det) group by 1, 2),
pk as (select payload_id, {_W} from grp group by 1),
kk as (select *, {_K} as k, ({_V}) / greatest(0.01, {_T}) as base, coalesce({', '.join(f'p_{d}' for d in D.DOMAINS)}) as lone from pk),
ids as (select payload_id, list(distinct sid) as ids from det group by 1),
rules as (select f.*, coalesce(k, 0) as k, coalesce(ids, []) as ids, round(case when list_contains(ids, 'HONEYTOKEN') then 100.0 else greatest(case when list_contains(ids, 'S1_CRED_DUMP') then 95.0 else 0.0 end,
  least(100.0, case when coalesce(k, 0) = 0 then 0.0 when k = 1 then lone * 0.8 else least(100.0, base + case when k >= 3 and base >= 35 then least(10.0, (k - 2) * 5.0) else 0.0 end) end)) end, 9) as rule_score
  from fx f left join kk using (payload_id) left join ids using (payload_id)),
a1 as (select *, case when edr_failed_auth_ratio_window between 0 and 1 then edr_failed_auth_ratio_window end as ratio, edr_auth_events_per_minute_window as epm, edr_auth_events_per_minute_window * 5 as good from rules),
a2 as (select *, greatest(0.0, coalesce(edr_failed_auth_event_count_window, edr_failed_auth_events_per_minute_window * 5, case when ratio < 1 then ratio * good / (1 - ratio) end, 0.0)) as failed from a1),
a3 as (select *, good + failed as total, coalesce(ratio, case when good + failed > 0 then failed / (good + failed) end) as share from a2),
a4 as (select *, case when unique_workstations_300s >= 3 and failed >= 4 and share >= 0.5 then 1 when share >= 0.75 and failed >= 5 then 2
  when unique_workstations_300s >= 3 and (total >= 4 or epm >= 1) and coalesce(share, 0) < 0.5 then 3 when failed >= 8 or (unique_workstations_300s >= 4 and total >= 8) then 4
  when (epm >= 3 and coalesce(share, 0) >= 0.5) or epm >= 5 then 5 when off_hours_auth_count >= 2 and total >= 3 then 6 else 0 end as arm from a3),
auth as (select *, ([0.0, 85, 85, 75, 70, 60, 35])[arm + 1]::double as a_score, ([0.0, 0.9, 0.9, 0.85, 0.82, 0.75, 0.6])[arm + 1]::double as a_conf,
  case arm when 1 then 'MULTI_WORKSTATION_BURST' when 2 then 'HIGH_FAILURE_BURST' when 3 then 'MULTI_WORKSTATION_BURST' when 4 then case when unique_workstations_300s >= 4 and total >= 8 then 'MULTI_WORKSTATION_BURST' else 'HIGH_FAILURE_BURST' end
    when 5 then 'VELOCITY_BURST' when 6 then 'OFF_HOURS_BURST' end as a_pattern from a4),
z1 as (select *, {', '.join(f'greatest(0.0, ({n} - {m}) / {s}) as z_{i}' for i, (n, (m, s)) in enumerate(PRIORS.items()))} from auth),
z2 as (select *, greatest(z_0, z_1, z_2, z_3) as zf, z_4 as zd, greatest(z_0, z_1, z_2, z_3, z_4) as zm from z1),
z3 as (select *, (zf > 2)::int + (zd > 2)::int as zk, case when zm <= 2 then 0.0 when zm <= 3 then (zm - 2) * 40 when zm <= 5 then 40 + (zm - 3) / 2 * 30 when zm <= 7 then 70 + (zm - 5) / 2 * 25 when zm <= 8 then 95 + (zm - 7) * 5 else 100.0 end as own from z2),
z4 as (select *, greatest(own, case when zk >= 2 then least(100.0, sqrt(pow(greatest(0, zf - 2), 2) + pow(greatest(0, zd - 2), 2)) * (100.0 / 6) * (1 + 0.15 * (zk - 1))) else 0.0 end) as zs from z3),
z5 as (select *, round(zs, 9) as z_score, round(case when zs > 0 then least(0.95, 0.45 + 0.05 * zm + 0.08 * greatest(0, zk - 1)) else 0.0 end, 9) as z_conf from z4),
pr as (select agent_id, ts::date as as_of, (sum(k) % 104) / 100.0::double as threat, (sum(k) % 80) / 100.0::double as fused, (sum(k) % 50) / 100.0::double as drift, (sum(k) % 60) / 100.0::double as pair, count(*) as n from obs group by 1, 2),
ml as (select agent_id, as_of + 1 as day, threat * 100 as ml_score, threat >= {U.THREAT} or drift >= {U.DRIFT} as ml_anomaly from pr where n % 3 <> 0 and n % 7 <> 0 and threat <= 1),
w1 as (select z.*, m.ml_score, m.ml_anomaly, len(ids) > 0 as fired from z5 z left join ml m on m.agent_id = z.agent_id and m.day = z.ts::date),
w2 as (select *, case when fired then 0.15 * case when rule_score >= 40 then 1 + 2 * pow((rule_score - 40) / 60, 2) * 0.9 else 1 end else 0.0 end as wr,
  case when z_conf > 0 then 0.1 * case when z_score >= 40 then 1 + 2 * pow((z_score - 40) / 60, 2) * z_conf else 1 end else 0.0 end as wz,
  case when a_conf > 0 then 0.05 * case when a_score >= 40 then 1 + 2 * pow((a_score - 40) / 60, 2) * a_conf else 1 end else 0.0 end as wa,
  case when ml_score is not null then 0.7 * case when ml_score >= 40 then 1 + 2 * pow((ml_score - 40) / 60, 2) * 0.85 else 1 end else 0.0 end as wm from w1),
raw as (select *, greatest(rule_score, case when wr + wz + wa + wm > 0 then (rule_score * wr + z_score * wz + a_score * wa + coalesce(ml_score, 0) * wm) / (wr + wz + wa + wm) else 0.0 end) as raw_score from w2),
hist as (select *, coalesce(max(raw_score) over h, 0.0) as past_max from raw window h as (partition by username, agent_id order by ts range between interval '4 hours' preceding and interval '1 microsecond' preceding)),
sm as (select *, case when past_max > 0 then greatest(raw_score, 0.85 * raw_score + 0.15 * least(100.0, past_max)) else raw_score end as smooth from hist),
c1 as (select *, service_modification_count > 0 as change, list_contains(ids, 'S2') or (z_score >= 35 and zf >= 2) or greatest(daily_unique_filename_count, sensitive_file_access, daily_new_filename_count) >= 100 as s2 from sm),
c2 as (select *, list_contains(ids, 'S1') or (file_delete_count >= 10 and change) or (change and (after_hours_logon >= 2 or list_contains(ids, 'S1_PRECURSOR') or a_score >= 60)) as s1,
  cloud_storage_uploads > 0 and (sensitive_file_access > 0 or s2) as s4 from c1),
cert as (select *, list_filter([case when threat_triggered then 'HONEYTOKEN' end, case when credential_dumping_suspected then 'S1_CRED_DUMP' end, case when unbacked_executable_regions > 0 then 'S1_INJECTION' end,
  case when tunneling_process_count > 0 or tunneling_detected then 'NETWORK_TUNNELING' end, case when s1 then 'S1' end, case when not s1 and file_delete_count >= 20 then 'S1_PRECURSOR' end, case when s2 then 'S2' end,
  case when moved > 0 then 'S3' end, case when moved <= 0 and usb_connect_count > 0 then 'S3_PRECURSOR' end, case when s4 then 'S4' end, case when not s4 and (cloud_storage_uploads > 0 or file_sharing_site_visits > 0) then 'S4_PRECURSOR' end], lambda x: x is not null) as cert from c2),
s1_ as (select *, list_concat(ids, cert) as every from cert),
s2_ as (select *, list_has_any(every, ['S1_CRED_DUMP', 'HONEYTOKEN']) or coalesce(a_pattern, '') in ('HIGH_FAILURE_BURST', 'VELOCITY_BURST') as t1,
  coalesce(a_pattern, '') = 'MULTI_WORKSTATION_BURST' or unique_workstations_300s >= 3 as t2, list_contains(every, 'S1_INJECTION') as t3, list_has_any(every, ['S2', 'S1_PRECURSOR']) or zf >= 3 as t4,
  list_has_any(every, ['S1', 'S3', 'S4', 'NETWORK_TUNNELING']) or zd >= 3.5 as t5 from s1_),
st as (select *, list_filter([case when t1 then 1 end, case when t2 then 2 end, case when t3 then 3 end, case when t4 then 4 end, case when t5 then 5 end], lambda x: x is not null) as kept,
  list_filter([case when t1 then 1 end, case when t2 then 2 end, case when t3 or modifications_detected or service_modification_count > 0 or unbacked_executable_regions > 0 then 3 end,
    case when t4 or sensitive_file_access > 0 or file_sharing_site_visits > 0 then 4 end, case when t5 or tunneling_detected or tunneling_process_count > 0 or moved > 0 then 5 end], lambda x: x is not null) as now_ from s2_),
ch as (select *, coalesce(list_distinct(flatten(list(kept) over (partition by username, agent_id order by ts range between interval '4 hours' preceding and interval '1 microsecond' preceding))), []) as past from st),
ch2 as (select *, len(list_filter(now_, lambda x: not list_contains(past, x))) as fresh, len(list_distinct(list_concat(now_, past))) as united from ch),
ch3 as (select *, case when len(past) > 0 and fresh > 0 and united >= 3 then 95.0 when len(past) > 0 and fresh > 0 and united >= 2 then 85.0 else 0.0 end as chain_floor from ch2),
g1 as (select *, case when list_has_any(cert, ['HONEYTOKEN', 'S1_CRED_DUMP']) then 90.0 when list_has_any(cert, ['S1_INJECTION', 'NETWORK_TUNNELING', 'S1', 'S3', 'S4']) then 70.0 when list_contains(cert, 'S2') then 40.0 else 0.0 end as cfloor from ch3),
g2 as (select *, greatest(smooth, cfloor, chain_floor) as pre, (coalesce(ml_score, 0) >= 75 and (rule_score >= 10 or z_score >= 25 or len(cert) > 0)) or (rule_score >= 60 and k >= 2) or coalesce(ml_score, 0) >= 85 or (a_score >= 85 and a_conf >= 0.85)
  or (z_score >= 85 and z_conf >= 0.85) or cfloor >= 70 or chain_floor > 0 as sure from g1),
fin as (select *, pre >= 70 and not sure as guarded, round(greatest(0.0, least(100.0, case when pre >= 70 and not sure then least(pre, 10.0) else pre end)), 9) as risk_score from g2)
"""


def _rules_of(name: str, places: tuple[str, ...]):
    keep = [i for i, r in enumerate(_RULES) if _PLACES[r[0]][1] in places or r[0] in places]

    @R.query(name, f"{_CTES} select payload_id, scenario, sid as scenario_id, domain, round(eff, 9) as effective from det where pos in ({', '.join(map(str, keep))})")
    def query(spark, sf_dir):
        own = F.filter("detections", lambda x: x["pos"].isin(*keep))
        found = D.detections(features(spark, sf_dir)).select("payload_id", F.explode_outer(own).alias("d")).where("d is not null")
        return found.select("payload_id", "d.scenario", "d.scenario_id", "d.domain", F.round("d.effective", 9).alias("effective"))


_rules_of("rules_logon", ("LOGON_TIME_GROUP", "LOGON_ASSET_GROUP", "LOGON_AUTH_GROUP"))
_rules_of("rules_file", ("FILE_EXFIL_GROUP", "FILE_SABOTAGE_GROUP", "File Transfer to Removable Media"))
_rules_of("rules_http", ("HTTP_EXFIL_GROUP", "HTTP_PRECURSOR_GROUP", "Cloud Upload Without File Correlation"))
_rules_of("rules_device", ("Bulk USB File Transfer", "Unapproved USB Device", "USB Device Activity"))
_rules_of("rules_direct", ("LSASS Credential Dumping Suspected", "Unbacked Executable Memory", "Network Tunneling Indicator", "HONEYTOKEN_GROUP", "SABOTAGE_GROUP"))


@R.query("rules_grouped", f"{_CTES} select payload_id, grp as group_id, domain, top as primary_scenario, round(score, 9) as group_score, n as rules from grp")
def rules_grouped(spark, sf_dir):
    g = D.grouped(D.detections(features(spark, sf_dir))).select("payload_id", F.explode_outer("groups").alias("g")).where("g is not null")
    return g.select("payload_id", "g.group_id", "g.domain", F.col("g.primary").alias("primary_scenario"), F.round("g.score", 9).alias("group_score"), "g.rules")


@R.query("rules_superposed", f"""{_CTES} select payload_id, rule_score, case when rule_score >= 90 then 'CRITICAL' when rule_score >= 70 then 'HIGH' when rule_score >= 40 then 'MEDIUM' else 'LOW' end as rule_level, k as n_domains from rules""")
def rules_superposed(spark, sf_dir):
    return D.evaluate(features(spark, sf_dir)).select("payload_id", "rule_score", "rule_level", F.size("domains").alias("n_domains"))


@R.query("rules_ranked", f"""{_CTES} select payload_id, string_agg(scenario, ';' order by case when pos in (14, 17) then 4 when pos in (3, 5, 7, 8, 15, 16, 18) or (pos = 11 and eff_raw >= 80) then 3 when pos in (9, 10, 13) then 1 else 2 end desc, eff desc, pos) as detections
  from (select d.*, case when d.pos = 11 and f.moved >= 20 then 80 else 0 end as eff_raw from det d join fx f using (payload_id)) group by 1""")
def rules_ranked(spark, sf_dir):
    d = D.detections(features(spark, sf_dir)).where(F.size("detections") > 0)
    return d.select("payload_id", F.array_join(D.ranked_detections(), ";").alias("detections"))


@R.query("auth_burst", f"{_CTES} select payload_id, a_score as score, a_conf as confidence, a_pattern as pattern, round(failed, 9) as failed, round(total, 9) as total from auth")
def auth_burst(spark, sf_dir):
    a = planned_burst(features(spark, sf_dir))
    return a.select("payload_id", "auth.score", "auth.confidence", "auth.pattern", F.round("auth.failed", 9).alias("failed"), F.round("auth.total", 9).alias("total"))


@R.query("zscore", f"{_CTES} select payload_id, z_score as score, z_conf as confidence, round(zm, 9) as max_z, zk as domains from z5")
def zscore(spark, sf_dir):
    z = planned_z(features(spark, sf_dir))
    return z.select("payload_id", "z.score", "z.confidence", F.round("z.max_z", 9).alias("max_z"), "z.domains")


@R.query("ml_prior_gate", f"{_CTES} select agent_id, day, ml_score as score, ml_anomaly as is_anomaly from ml")
def ml_prior_gate(spark, sf_dir):
    p = _priors(spark, sf_dir)
    keyed = p.withColumn("agent_id", F.struct("agent_id", F.date_add("as_of", 1).alias("day")))
    out = U.prior_detector(keyed, F.col("as_of")).where("ml is not null")
    return out.select("agent_id.agent_id", "agent_id.day", "ml.score", "ml.is_anomaly")


@R.query("ensemble", f"{_CTES} select payload_id, round(raw_score, 9) as raw_score from raw")
def ensemble(spark, sf_dir):
    return _fused(spark, sf_dir).select("payload_id", F.round("raw_score", 9).alias("raw_score"))


@R.query("history_max_4h", f"{_CTES} select payload_id, round(past_max, 9) as past_max, round(smooth, 9) as smooth_score from sm")
def history_max_4h(spark, sf_dir):
    return _fused(spark, sf_dir).select("payload_id", F.round("past_max", 9).alias("past_max"), F.round("smooth_score", 9).alias("smooth_score"))


@R.query("cert_scenarios", f"{_CTES} select payload_id, array_to_string(cert, ',') as scenarios from cert")
def cert_scenarios(spark, sf_dir):
    return U.scenarios(_signals(spark, sf_dir)).select("payload_id", F.array_join(F.transform("cert", lambda c: c["id"]), ",").alias("scenarios"))


_STAGE = f"array_to_string(list_transform({{}}, lambda x: ({list(U.STAGES)})[x]), ',')"


@R.query("stages", f"{_CTES} select payload_id, {_STAGE.format('now_')} as stages, {_STAGE.format('kept')} as kept_stages from st")
def stages(spark, sf_dir):
    s = U.stages(U.scenarios(_signals(spark, sf_dir)))
    return s.select("payload_id", F.array_join("stages", ",").alias("stages"), F.array_join("kept_stages", ",").alias("kept_stages"))


@R.query("kill_chain", f"{_CTES} select payload_id, {_STAGE.format('list_sort(past)')} as past_stages, chain_floor::double as chain_floor from ch3")
def kill_chain(spark, sf_dir):
    k = U.kill_chain(U.stages(U.scenarios(_signals(spark, sf_dir))))
    ordered = F.filter(F.array(*map(F.lit, U.STAGES)), lambda s: F.array_contains("past_stages", s))
    return k.select("payload_id", F.array_join(ordered, ",").alias("past_stages"), "chain_floor")


@R.query("fused_risk", f"{_CTES} select payload_id, risk_score, case when risk_score >= 90 then 'critical' when risk_score >= 70 then 'high' when risk_score >= 40 then 'medium' else 'low' end as risk_level from fin")
def fused_risk(spark, sf_dir):
    return _fused(spark, sf_dir).select("payload_id", "risk_score", "risk_level")


@R.query("risk_guard", f"{_CTES} select payload_id, guarded, risk_score from fin where pre >= 70")
def risk_guard(spark, sf_dir):
    f = _fused(spark, sf_dir)
    return f.where(F.col("guarded") | (F.col("risk_score") >= 70)).select("payload_id", "guarded", "risk_score")

"""Adaptive baselines over snapshots' features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.identity import role_of, truthy
from riskloom.operators import baseline as B
from riskloom.plans import detection
from riskloom.plans.registry import Registry
from riskloom.sources.views import AS_OF_DAY, features, with_sql

R = Registry()
QUERIES, SQL = R.queries, R.sql
USER = ["daily_unique_filename_count", "daily_new_filename_count", "file_access_count", "file_sharing_site_visits", "edr_failed_auth_ratio_window", "edr_failed_auth_event_count_window"]
HOST = ["off_hours_auth_count", "daily_unique_pc_count", "edr_failed_auth_ratio_window", "edr_failed_auth_event_count_window"]


def _seen(spark, sf_dir):
    """Snapshots with the role that their sender states or that their name tells."""
    stated = F.when(F.col("role") == 0, " Data Engineer").when(F.col("role") == 1, "").otherwise(F.lit(None))
    return features(spark, sf_dir).withColumn("role_name", role_of(F.col("username"), stated))


def _before(df):
    return df.where(F.col("ts") < F.lit(AS_OF_DAY).cast("timestamp_ntz"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_ROLE = "case role when 0 then 'data_engineer' else 'standard_user' end"
_SEEN = f"{with_sql('feats')}, seen as (select *, {_ROLE} as role_name from feats)"


def _floor(mean: str, least: float) -> str:
    return f"greatest(abs({mean}) * 0.1, case when regexp_matches(feature, 'ratio|rate|entropy') then 0.05 else {least} end)"


def _taken(name: str, keys: str, entity: str, where: str = "true") -> str:
    """The greedy choice as a walk from each row taken to the next one that fits."""
    same = " and ".join(f"o.{k} = a.{k}" for k in keys.split(", "))
    cols = ", ".join(f"o.{k}" for k in keys.split(", "))
    return f"""
{name}_o as (select *, row_number() over (partition by {keys} order by ts, payload_id) as rn from seen where {where}),
{name}_w as (select {keys}, ts, payload_id from {name}_o where rn = 1
  union all select {keys}, ts, payload_id from (select {cols}, o.ts, o.payload_id, row_number() over (partition by {cols} order by o.ts, o.payload_id) as nx
    from {name}_w a join {name}_o o on {same} and o.ts >= a.ts + interval 1 hour) where nx = 1),
{name} as (select o.*, {entity} as entity, o.ts::date as day, max(o.ts::date) over (partition by {entity}) as last_day,
  row_number() over (partition by {entity} order by o.ts, o.payload_id) as nth from {name}_o o semi join {name}_w w on o.payload_id = w.payload_id)"""


def _tall(name: str, feats: list[str], extra: str) -> str:
    return " union all ".join(f"select {extra}, '{f}' as feature, {f}::double as value from {name} where {f} is not null" for f in feats)


_Q = 2.0 / 15.0


def _ema(name: str, least: float) -> str:
    mean = f"({1 - _Q} * e.mean + {_Q} * d.average)"
    return f"""
{name}_d as (select entity, feature, day, avg(value) as average, row_number() over (partition by entity, feature order by day) as i from ({_tall(name, USER, 'entity, day, last_day')}) where day < last_day group by 1, 2, 3),
{name}_e as (select entity, feature, 1::bigint as i, average as mean, {_floor('average', least)} as std from {name}_d where i = 1
  union all select d.entity, d.feature, d.i, {mean}, greatest({1 - _Q} * e.std + {_Q} * abs(d.average - e.mean), {_floor(mean, least).replace('feature', 'd.feature')})
  from {name}_e e join {name}_d d on d.entity = e.entity and d.feature = e.feature and d.i = e.i + 1),
{name}_s as (select entity, feature, arg_max(mean, i) as mean, arg_max(std, i) as std, max(i) as samples from {name}_e group by 1, 2)"""


@R.query("baseline_role_of", f"{_SEEN} select payload_id, username, role_name from seen")
def baseline_role_of(spark, sf_dir):
    return _seen(spark, sf_dir).select("payload_id", "username", "role_name")


@R.query("baseline_throttle", f"{_SEEN}, {_taken('u', 'username', 'o.username')} select payload_id, username, ts from u")
def baseline_throttle(spark, sf_dir):
    return B.throttle(_seen(spark, sf_dir), ["username"]).select("payload_id", "username", "ts")


@R.query("baseline_user", f"{_SEEN}, {_taken('u', 'username', 'o.username')}, {_ema('u', 1.0)} select entity as username, feature, round(mean, 6) as mean, round(std, 6) as std, samples from u_s")
def baseline_user(spark, sf_dir):
    return _rounded(B.moving_average(B.throttle(_seen(spark, sf_dir), ["username"]), "username", USER))


@R.query("baseline_role", f"{_SEEN}, {_taken('r', 'role_name, username', 'o.role_name')}, {_ema('r', 1.0)} select entity as role_name, feature, round(mean, 6) as mean, round(std, 6) as std, samples from r_s")
def baseline_role(spark, sf_dir):
    return _rounded(B.moving_average(B.throttle(_seen(spark, sf_dir), ["role_name", "username"]), "role_name", USER))


_TOP = f"e.mean + 3 * greatest(e.std, {_floor('e.mean', 0.5).replace('feature', 'd.feature')})"
_HELD = f"list_avg([greatest(0.0, case when x.nth >= 5 then least(x.value, {_TOP}) else x.value end) for x in d.xs])"
_HMEAN = f"({1 - _Q} * mean + {_Q} * average)"


_BOUNDED = f"""{_taken('h', 'agent_id', 'o.agent_id')},
h_d as (select entity, feature, day, list({{'nth': nth, 'value': value}} order by nth) as xs, row_number() over (partition by entity, feature order by day) as i
  from ({_tall('h', HOST, 'entity, day, last_day, nth')}) where day < last_day group by 1, 2, 3),
h_e as (select entity, feature, i, average as mean, {_floor('average', 0.5)} as std from (select *, list_avg([greatest(0.0, x.value) for x in xs]) as average from h_d where i = 1)
  union all select entity, feature, i, {_HMEAN}, greatest({1 - _Q} * std + {_Q} * abs(average - mean), {_floor(_HMEAN, 0.5)})
  from (select d.entity, d.feature, d.i, e.mean, e.std, {_HELD} as average from h_e e join h_d d on d.entity = e.entity and d.feature = e.feature and d.i = e.i + 1))
select entity as agent_id, feature, round(arg_max(mean, i), 6) as mean, round(arg_max(std, i), 6) as std, max(i) as samples from h_e group by 1, 2"""


@R.query("baseline_host", f"{_SEEN}, {_BOUNDED}")
def baseline_host(spark, sf_dir):
    return _rounded(B.bounded_average(B.throttle(_seen(spark, sf_dir), ["agent_id"]), "agent_id", HOST))


@R.query(
    "baseline_confidence",
    f"""{_SEEN}, {_taken('u', 'username', 'o.username')}
select username, coalesce(n, 0) as sample_count, case when n > 0 then least(n / 14.0, 1.0) else 0.1 end::double as confidence
from (select distinct username from seen) left join (select username, count(*) as n from u group by 1) using (username)""",
)
def baseline_confidence(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    counts = B.throttle(seen, ["username"]).groupBy("username").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return seen.select("username").distinct().join(counts, "username", "left").select("username", n.cast("long").alias("sample_count"), B.confidence(n).alias("confidence"))


_DAY = f"ts < timestamp '{AS_OF_DAY}'"
_PRIOR = " ".join(f"when '{f}' then {{'mean': {B.USER_PRIORS[f][0]}::double, 'std': {B.USER_PRIORS[f][1]}::double}}" for f in USER if f in B.USER_PRIORS)


@R.query(
    "baseline_deviation",
    f"""{_SEEN}, {_taken('u', 'username', 'o.username', _DAY)}, {_ema('u', 1.0)}, {_taken('r', 'role_name, username', 'o.role_name', _DAY)}, {_ema('r', 1.0)},
v as ({_tall('(select * from seen where not ' + _DAY + ')', USER, 'payload_id, username, role_name')}),
b as (select v.*, u.mean as um, u.std as us, r.mean as rm, r.std as rs, case v.feature {_PRIOR} end as p from v
  left join u_s u on u.entity = username and u.feature = v.feature and u.samples >= 5 left join r_s r on r.entity = role_name and r.feature = v.feature and r.samples >= 5),
m as (select *, coalesce(um, rm, p.mean) as mean, case when um is not null then us when rm is not null then rs else p.std end as std from b)
select payload_id, username, feature, case when mean is null then 0.0 else round((value - mean) / greatest(std, {_floor('mean', 1.0)}), 6) end::double as z,
  case when um is not null then 'user' when rm is not null then 'role' when mean is not null then 'prior' else 'none' end as tier from m""",
)
def baseline_deviation(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    old = _before(seen)
    users = B.moving_average(B.throttle(old, ["username"]), "username", USER)
    roles = B.moving_average(B.throttle(old, ["role_name", "username"]), "role_name", USER)
    today = seen.where(F.col("ts") >= F.lit(AS_OF_DAY).cast("timestamp_ntz"))
    return B.deviations(today, users, roles, USER).withColumn("z", F.round("z", 6))


_VIEW = " union all ".join(f"select entity, '{f}' as feature, (count(*) - count({f}))::bigint as missing from u where day < last_day group by 1" for f in USER)


@R.query("baseline_rolling_view", f"""{_SEEN}, {_taken('u', 'username', 'o.username')}, {_ema('u', 1.0)}, ms as ({_VIEW})
select s.entity as username, row_number() over (partition by s.entity order by feature)::int as place, feature, round(mean, 6) as mean, round(std, 6) as std, samples, missing from u_s s join ms using (entity, feature)""")
def baseline_rolling_view(spark, sf_dir):
    """Each user's features in the order of names, with state and gaps."""
    taken = B.throttle(_seen(spark, sf_dir), ["username"])
    view = B.rolling_view(B.moving_average(taken, "username", USER), taken, "username", USER)
    rows = view.select("username", F.posexplode("samples").alias("at", "s"))
    return _rounded(rows.select("username", (F.col("at") + 1).alias("place"), "s.feature", "s.mean", "s.std", "s.samples", "s.missing"))


_HERE = {"user": ("daily_unique_filename_count", "daily_new_filename_count", "file_access_count", "file_sharing_site_visits"), "host": ("unique_workstations_300s", "edr_auth_events_per_minute_window", "off_hours_auth_count", "daily_unique_pc_count")}
_SELECTED = " union all ".join(f"select payload_id, '{kind}' as baseline, '{f}' as feature, {f}::double as value from feats where {f} is not null" for kind, names in _HERE.items() for f in names)


@R.query("baseline_features", f"{with_sql('feats')} {_SELECTED}")
def baseline_features(spark, sf_dir):
    """The features of a snapshot that go to its user's and to its host's baseline."""
    f = features(spark, sf_dir)
    parts = [B.selected(f, ["payload_id"], names).withColumn("baseline", F.lit(kind)) for kind, names in (("user", B.USER_FEATURES), ("host", B.HOST_FEATURES))]
    return parts[0].unionByName(parts[1])


# Scored first, then learnt from: what alerts teaches nothing.
_CALM = f"{detection._CTES}, seen as (select f.*, {_ROLE.replace('role', 'f.role', 1)} as role_name from feats f join fin using (payload_id) where fin.risk_score < 40"
_SURE = "and fin.a_score = 0 and not coalesce(f.credential_dumping_suspected, false) and not coalesce(f.threat_triggered, false)"


def _scored(spark, sf_dir):
    risk = detection._fused(spark, sf_dir).select("payload_id", "risk_score", (F.col("auth.score") > 0).alias("burst"))
    return _seen(spark, sf_dir).join(risk, "payload_id")


@R.query("baseline_user_gated", f"{_CALM}), {_taken('u', 'username', 'o.username')}, {_ema('u', 1.0)} select entity as username, feature, round(mean, 6) as mean, round(std, 6) as std, samples from u_s")
def baseline_user_gated(spark, sf_dir):
    calm = _scored(spark, sf_dir).where(B.teaches_user(F.col("risk_score")))
    return _rounded(B.moving_average(B.throttle(calm, ["username"]), "username", USER))


@R.query("baseline_host_gated", f"{_CALM} {_SURE}), {_BOUNDED}")
def baseline_host_gated(spark, sf_dir):
    flags = [truthy(F.col(c)) for c in ("credential_dumping_suspected", "threat_triggered")]
    calm = _scored(spark, sf_dir).where(B.teaches_host(F.col("risk_score"), F.col("burst"), flags))
    return _rounded(B.bounded_average(B.throttle(calm, ["agent_id"]), "agent_id", HOST))

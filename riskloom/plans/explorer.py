"""Explorer queries: histograms, pages, latest state, enrichment, store merges, outbox."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.operators import explorer as X
from riskloom.plans.registry import Registry
from riskloom.sources.views import AS_OF, AS_OF_SQL, now, observations, payloads, risk_events, table, with_sql

R = Registry()
QUERIES, SQL = R.queries, R.sql
CURSOR = (datetime(2024, 1, 20, 7, 30), 6000)
PAGE = ["event_id", "payload_id", "agent_id", "collector", "ts", "hostname", "username", "status"]
_COLS = ", ".join(PAGE)


def _cursor(order=("ts", "event_id")):
    return X.after(list(order), [F.lit(CURSOR[0]).cast("timestamp_ntz"), F.lit(CURSOR[1]).cast("long")])


def _bucket_sql(seconds: int, ts: str = "ts") -> str:
    return f"time_bucket(interval '{seconds} seconds', {ts}, timestamp '1970-01-01')"


# -- histograms ------------------------------------------------------------------------------------

for _name, _range, _interval in (("hist_1m", "1h", None), ("hist_5m", "15m", "5m"), ("hist_15m", "24h", None), ("hist_1h", "24h", "1h"), ("hist_1d", "all", None)):
    _seconds, _usual = X.RANGES[_range]
    _step = X.INTERVALS[_interval or _usual]

    @R.query(_name, f"""{with_sql('obs')} select {_bucket_sql(_step)} as bucket, count(distinct event_id) as events from obs
      where ts >= {AS_OF_SQL} - interval '{_seconds} seconds' and ts <= {AS_OF_SQL} group by 1""")
    def _hist(spark, sf_dir, name=_range, interval=_interval):
        return X.range_histogram(observations(spark, sf_dir), name, AS_OF, interval)


@R.query("hist_2h", f"{with_sql('obs')} select {_bucket_sql(7200)} as bucket, count(distinct event_id) as events from obs group by 1")
def hist_2h(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return X.histogram(obs.where(X.has_status(F.col("status"), "error") | X.has_status(F.col("status"), "success")), 7200)


@R.query("hist_custom", f"""{with_sql('obs')} select {_bucket_sql(86400)} as bucket, count(distinct event_id) as events from obs
  where ts >= timestamp '2024-01-05 06:00:00' and ts < timestamp '2024-01-12 18:00:00' and collector = 'process' and status in ('failed', 'critical') group by 1""")
def hist_custom(spark, sf_dir):
    obs = observations(spark, sf_dir).where(X.within(F.col("ts"), datetime(2024, 1, 5, 6), datetime(2024, 1, 12, 18), half_open=True))
    return X.histogram(obs.where(X.is_collector(F.col("collector"), "process-monitor") & X.has_status(F.col("status"), "error")), 86400)


# -- pages -----------------------------------------------------------------------------------------


@R.query("page_first", f"{with_sql('obs')} select {_COLS} from obs where ts >= {AS_OF_SQL} - interval 30 day order by ts desc, event_id desc limit 51")
def page_first(spark, sf_dir):
    obs = observations(spark, sf_dir).where(F.col("ts") >= now() - F.expr("interval 30 days"))
    return X.page(obs.select(*PAGE), 50)


@R.query("page_seek", f"""{with_sql('obs')} select {_COLS} from obs where (ts, event_id) < (timestamp '{CURSOR[0]}', {CURSOR[1]})
  order by ts desc, event_id desc limit 51""")
def page_seek(spark, sf_dir):
    return X.page(observations(spark, sf_dir).where(_cursor()).select(*PAGE), 50)


@R.query("page_offset", f"{with_sql('obs')} select {_COLS} from obs where lower(hostname) = 'host-7' order by ts desc, event_id desc limit 21 offset 40")
def page_offset(spark, sf_dir):
    return X.page(observations(spark, sf_dir).where(X.same(F.col("hostname"), "host-7")).select(*PAGE), 20, 40)


@R.query("page_search", f"""{with_sql('obs')} select {_COLS} from obs
  where contains(lower(username), 'r-14') or contains(lower(hostname), 'r-14') or contains(lower(status), 'r-14') or contains(lower(payload), 'r-14')
  order by ts desc, event_id desc limit 101""")
def page_search(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return X.page(obs.where(X.any_of(X.contains(F.col(c), "R-14") for c in ("username", "hostname", "status", "payload"))).select(*PAGE), 100)


@R.query("page_ilike", f"{with_sql('obs')} select {_COLS} from obs where username ilike 'user-1%9' and agent_id = 'AGENT-19' order by ts desc, event_id desc limit 101")
def page_ilike(spark, sf_dir):
    return X.page(observations(spark, sf_dir).where(F.col("username").ilike("user-1%9") & (F.col("agent_id") == "AGENT-19")).select(*PAGE), 100)


@R.query("page_alias", f"""{with_sql('obs')} select {_COLS} from obs where collector in ('device', 'usb') or collector like '%usb%'
  order by ts desc, event_id desc limit 101""")
def page_alias(spark, sf_dir):
    return X.page(observations(spark, sf_dir).where(X.is_collector(F.col("collector"), "usb-monitor")).select(*PAGE), 100)


@R.query("page_nulls_last", f"""{with_sql('obs')} select event_id, case when event_id % 4 <> 0 then ts end as ts, username from obs where username = 'user-3'
  order by 2 desc nulls last, event_id desc limit 201""")
def page_nulls_last(spark, sf_dir):
    obs = observations(spark, sf_dir).where(F.col("username") == "user-3")
    return X.page(obs.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("ts"), "username"), 200)


@R.query("page_snapshot", f"""{with_sql('obs')} select {_COLS} from obs where ts <= timestamp '2024-01-25 00:00:00' and event_id <= 7500
  and (ts, event_id) < (timestamp '{CURSOR[0]}', {CURSOR[1]}) and not payload_id in (select payload_id from obs where status = 'critical')
  order by ts desc, event_id desc limit 51""")
def page_snapshot(spark, sf_dir):
    obs = observations(spark, sf_dir)
    hidden = obs.where(F.col("status") == "critical").select("payload_id")
    seen = obs.where(X.visible(F.col("ts"), F.col("event_id"), datetime(2024, 1, 25), 7500) & _cursor())
    return X.page(seen.join(hidden, "payload_id", "left_anti").select(*PAGE), 50)


@R.query("multi_store_merge", f"{with_sql('obs')} select {_COLS} from obs order by ts desc, event_id desc limit 200")
def multi_store_merge(spark, sf_dir):
    obs = observations(spark, sf_dir).select(*PAGE)
    day = lambda d: F.lit(datetime(2024, 1, d)).cast("timestamp_ntz")
    hot, archive, pending = obs.where(F.col("ts") >= day(20)), obs.where(F.col("ts") < day(30)), obs.where(F.col("event_id") % 3 == 0)
    return X.merged([hot, archive, pending], 200)


# -- semi-joins, latest rows, enrichment -----------------------------------------------------------


@R.query("semi_collector_status", f"""{with_sql('obs', 'payloads')} select payload_id, agent_id, username, received_at from payloads p
  where exists (select 1 from obs o where o.payload_id = p.payload_id and contains(o.collector, 'process') and o.status in ('error', 'failed', 'critical', 'tampered'))
  order by received_at desc, payload_id desc limit 101""")
def semi_collector_status(spark, sf_dir):
    bad = observations(spark, sf_dir).where(X.is_collector(F.col("collector"), "process") & X.has_status(F.col("status"), "error"))
    found = payloads(spark, sf_dir).join(bad.select("payload_id"), "payload_id", "left_semi")
    return X.page(found.select("payload_id", "agent_id", "username", "received_at"), 100, order=("received_at", "payload_id"))


_LATEST = "select agent_id, collector, event_id, payload_id, ts, status from obs qualify row_number() over (partition by agent_id, collector order by ts desc, payload_id desc, event_id desc) = 1"


@R.query("latest_state", f"{with_sql('obs')} {_LATEST}")
def latest_state(spark, sf_dir):
    obs = observations(spark, sf_dir).select("agent_id", "collector", "event_id", "payload_id", "ts", "status")
    return X.latest(obs, ["agent_id", "collector"], ["ts", "payload_id", "event_id"])


@R.query("state_staleness", f"""{with_sql('obs')}, latest as ({_LATEST}), aged as (select *, greatest(0, (epoch_us({AS_OF_SQL}) - epoch_us(ts)) // 1000000) as age_seconds from latest)
  select agent_id, collector, ts, age_seconds, coalesce(age_seconds > 600, true) as stale from aged""")
def state_staleness(spark, sf_dir):
    age = F.greatest(F.lit(0).cast("long"), F.expr(f"timestampdiff(second, ts, timestamp_ntz '{AS_OF}')"))
    return latest_state(spark, sf_dir).select("agent_id", "collector", "ts", age.alias("age_seconds"), F.coalesce(age > 600, F.lit(True)).alias("stale"))


@R.query("latest_state_fallback", f"""{with_sql('obs')}, latest as ({_LATEST}),
  feats as (select event_id, case when event_id % 2 = 0 then k end as k_value from obs)
  select l.agent_id, l.collector, l.event_id, case when l.event_id % 3 = 0 then null else f.k_value end as payload_k, coalesce(case when l.event_id % 3 = 0 then null else f.k_value end, f.k_value, -1) as shown
  from latest l left join feats f using (event_id)""")
def latest_state_fallback(spark, sf_dir):
    """A state without payload shows what its feature rows say."""
    maps = observations(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, F.map_from_arrays(F.array(F.lit("k")), F.array("k"))).alias("features"))
    met = latest_state(spark, sf_dir).join(maps, "event_id", "left")
    own = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("features")["k"])
    return met.select("agent_id", "collector", "event_id", own.alias("payload_k"), F.coalesce(own, F.col("features")["k"], F.lit(-1).cast("long")).alias("shown"))


@R.query("latest_risk_per_agent", f"{with_sql('risk')} select agent_id, risk_id, payload_id, risk_score, created_at from risk qualify row_number() over (partition by agent_id order by created_at desc, risk_id desc) = 1")
def latest_risk_per_agent(spark, sf_dir):
    return X.latest(risk_events(spark, sf_dir).select("agent_id", "risk_id", "payload_id", "risk_score", "created_at"), ["agent_id"], ["created_at", "risk_id"])


@R.query("latest_risk_per_payload", f"{with_sql('risk')} select payload_id, risk_id, risk_score from risk qualify row_number() over (partition by payload_id order by created_at desc, risk_id desc) = 1")
def latest_risk_per_payload(spark, sf_dir):
    found = X.latest(risk_events(spark, sf_dir).select("payload_id", "risk_id", "risk_score", "created_at"), ["payload_id"], ["created_at", "risk_id"])
    return found.select("payload_id", "risk_id", "risk_score")


@R.query("user_collectors", f"""{with_sql('obs', 'payloads')}
  select collector, event_id, payload_id, received_at, status from (select o.collector, o.event_id, o.payload_id, p.received_at, o.status from obs o join payloads p using (payload_id) where p.username = 'user-5')
  qualify row_number() over (partition by collector order by received_at desc, event_id desc) = 1""")
def user_collectors(spark, sf_dir):
    mine = payloads(spark, sf_dir).where(F.col("username") == "user-5").select("payload_id", "received_at")
    met = observations(spark, sf_dir).join(mine, "payload_id").select("collector", "event_id", "payload_id", "received_at", "status")
    return X.latest(met, ["collector"], ["received_at", "event_id"])


@R.query("payload_meta_page", f"""{with_sql('obs', 'payloads')}, top as (select event_id, payload_id, collector, ts from obs order by ts desc, event_id desc limit 101)
  select t.*, p.username as sender, p.received_at from top t left join payloads p using (payload_id)""")
def payload_meta_page(spark, sf_dir):
    """The page first, then the meta data of its payloads alone."""
    obs = observations(spark, sf_dir)
    top = X.page(obs.select("event_id", "payload_id", "collector", "ts"), 100)
    near = obs.join(F.broadcast(top.select("payload_id").distinct()), "payload_id", "left_semi")  # page-sized by its limit
    meta = near.groupBy("payload_id").agg(F.min_by("username", "event_id").alias("sender"), F.max("ts").alias("received_at"))
    return top.join(meta, "payload_id", "left").select("event_id", "payload_id", "collector", "ts", "sender", "received_at")


@R.query("enriched_page", f"""{with_sql('obs', 'risk')}, top as (select event_id, payload_id, collector, ts from obs where collector = 'http' order by ts desc, event_id desc limit 51),
  newest as (select payload_id, risk_id, risk_score from risk qualify row_number() over (partition by payload_id order by created_at desc, risk_id desc) = 1)
  select t.*, n.risk_id, n.risk_score from top t left join newest n using (payload_id)""")
def enriched_page(spark, sf_dir):
    top = X.page(observations(spark, sf_dir).where(F.col("collector") == "http").select("event_id", "payload_id", "collector", "ts"), 50)
    risk = risk_events(spark, sf_dir).join(F.broadcast(top.select("payload_id").distinct()), "payload_id", "left_semi")
    newest = X.latest(risk.select("payload_id", "risk_id", "risk_score", "created_at"), ["payload_id"], ["created_at", "risk_id"])
    return top.join(newest, "payload_id", "left").select("event_id", "payload_id", "collector", "ts", "risk_id", "risk_score")


@R.query("event_detail", f"""{with_sql('obs', 'risk')} select o.event_id, o.ts, r.risk_id, r.created_at, r.risk_score from (select * from obs where event_id = 123) o
  left join risk r on r.agent_id = o.agent_id and r.created_at between o.ts - interval 2 day and o.ts + interval 2 day""")
def event_detail(spark, sf_dir):
    """One event, looked up, with its agent's risk events of two days before and after: the look-up prunes the risk table by agent and time."""
    return X.event_detail(observations(spark, sf_dir).select("event_id", "agent_id", "ts"), risk_events(spark, sf_dir).select("agent_id", "risk_id", "created_at", "risk_score"), 123)


@R.query("event_detail_counts", f"""{with_sql('obs', 'risk')} select event_id, agent_id, ts, count(risk_id) as risks, max(risk_score) as most, max(struct_pack(c := created_at, i := risk_id)).i as latest
  from (select o.event_id, o.agent_id, o.ts, r.risk_id, r.created_at, r.risk_score from obs o left join risk r on r.agent_id = o.agent_id and r.created_at between o.ts - interval 2 day and o.ts + interval 2 day) group by 1, 2, 3""")
def event_detail_counts(spark, sf_dir):
    """For every event how many risk events its agent has within two days, the highest and the latest: running values of hours, no pairs."""
    return X.risk_around(observations(spark, sf_dir).select("event_id", "agent_id", "ts"), risk_events(spark, sf_dir).select("agent_id", "risk_id", "created_at", "risk_score"))


@R.query("risk_with_agents", f"""{with_sql('risk')}, agents as (select 'AGENT-' || c_custkey as agent_id, c_name as hostname from customer where c_custkey % 2 = 0)
  select r.risk_id, r.agent_id, coalesce(a.hostname, r.agent_id) as host, r.risk_score from risk r left join agents a using (agent_id)
  order by created_at desc, risk_id desc limit 200""")
def risk_with_agents(spark, sf_dir):
    newest = risk_events(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("risk_id")).limit(200)
    agents = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("AGENT-"), F.col("c_custkey").cast("string")).alias("agent_id"), F.col("c_name").alias("name"))
    return newest.join(agents, "agent_id", "left").select("risk_id", "agent_id", F.coalesce("name", "agent_id").alias("host"), "risk_score")


_MINE = "username = 'user-9' or hostname = 'HOST-9' or (signals->>'$.hostname') = 'HOST-9'"


@R.query("host_risk_scores", f"""{with_sql('obs', 'risk')}, a as (select agent_id, 'PC ' || max(hostname) as name from obs group by 1)
  select risk_id, risk_score, created_at from risk left join a using (agent_id) where username = 'PC HOST-9' or a.name = 'PC HOST-9' or (signals->>'$.hostname') = 'PC HOST-9' order by created_at desc, risk_id desc limit 30""")
def host_risk_scores(spark, sf_dir):
    """The newest thirty of whom a name means: a user, an agent's host in the list of agents, or a host that the signals name."""
    agents = observations(spark, sf_dir).groupBy("agent_id").agg(F.concat(F.lit("PC "), F.max("hostname")).alias("hostname"))
    return X.named_risk(risk_events(spark, sf_dir), agents, "PC HOST-9", 30).select("risk_id", "risk_score", "created_at")


@R.query("user_risk_scores", f"""{with_sql('risk')}, newest as (select risk_id, risk_score, created_at from risk where {_MINE} order by created_at desc, risk_id desc limit 30)
  select risk_id, risk_score, created_at, row_number() over (order by created_at, risk_id) as pos from newest""")
def user_risk_scores(spark, sf_dir):
    """The newest thirty, oldest first; the window runs over those thirty."""
    from pyspark.sql import Window

    mine = (F.col("username") == "user-9") | (F.col("hostname") == "HOST-9") | (F.get_json_object("signals", "$.hostname") == "HOST-9")
    newest = risk_events(spark, sf_dir).where(mine).orderBy(F.desc("created_at"), F.desc("risk_id")).limit(30)
    return newest.select("risk_id", "risk_score", "created_at", F.row_number().over(Window.orderBy("created_at", "risk_id")).cast("long").alias("pos"))


@R.query("recent_scores_by_host", f"""{with_sql('risk', 'payloads')} select risk_id, risk_score, created_at from risk
  where payload_id in (select payload_id from payloads where hostname = 'HOST-4') order by created_at desc, risk_id desc limit 50""")
def recent_scores_by_host(spark, sf_dir):
    host = payloads(spark, sf_dir).where(F.col("hostname") == "HOST-4").select("payload_id")
    found = risk_events(spark, sf_dir).join(host, "payload_id", "left_semi")
    return found.orderBy(F.desc("created_at"), F.desc("risk_id")).limit(50).select("risk_id", "risk_score", "created_at")


@R.query("max_score_window", f"{with_sql('risk')} select username, max(risk_score) as max_score from risk where created_at >= {AS_OF_SQL} - interval 72 hour and created_at <= {AS_OF_SQL} group by 1")
def max_score_window(spark, sf_dir):
    recent = risk_events(spark, sf_dir).where(X.within(F.col("created_at"), AS_OF - timedelta(hours=72), AS_OF))
    return recent.groupBy("username").agg(F.max("risk_score").alias("max_score"))


# -- statistics, rollups ---------------------------------------------------------------------------


@R.query("stats_collector_status", f"{with_sql('obs')} select collector, status, count(distinct event_id) as events, count(*) as rows_seen, max(ts) as last_seen from obs group by 1, 2")
def stats_collector_status(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("collector", "status").agg(F.count_distinct("event_id").alias("events"), F.count("*").alias("rows_seen"), F.max("ts").alias("last_seen"))


@R.query("rollup_minute_all", f"{with_sql('obs')} select date_trunc('minute', ts) as minute, collector, status, agent_id, count(distinct event_id) as events from obs group by 1, 2, 3, 4")
def rollup_minute_all(spark, sf_dir):
    return _by_minute(observations(spark, sf_dir))


def _by_minute(obs):
    return X.minute_rollup(obs, ["collector", "status", "agent_id"]).groupBy("minute", "collector", "status", "agent_id").agg(F.count("event_id").alias("events"))


@R.query("rollup_merge", f"{with_sql('obs')} select {_bucket_sql(3600)} as bucket, count(distinct event_id) as events from obs where collector = 'file' group by 1")
def rollup_merge(spark, sf_dir):
    """Two slices that overlap, rolled up apart and merged, count as the events themselves."""
    obs = observations(spark, sf_dir).where(F.col("collector") == "file")
    a, b = obs.where(X.within(F.col("ts"), end=datetime(2024, 1, 20))), obs.where(X.within(F.col("ts"), datetime(2024, 1, 10)))
    return X.merge_rollups([X.minute_rollup(x, ["status", "agent_id"]) for x in (a, b)], 3600)


@R.query("replacing_final", f"{with_sql('obs')} select agent_id, ts::date as day, event_id as version, k from obs qualify row_number() over (partition by agent_id, ts::date order by event_id desc) = 1")
def replacing_final(spark, sf_dir):
    rows = observations(spark, sf_dir).select("agent_id", F.to_date("ts").alias("day"), F.col("event_id").alias("version"), "k")
    return X.replacing(rows, ["agent_id", "day"], "version")


@R.query("archive_totals", f"""{with_sql('obs')}, live as (select collector, status, count(distinct event_id) as n from obs where ts >= timestamp '2024-01-25' group by 1, 2),
  old as (select collector, status, count(distinct event_id) as n from obs where ts < timestamp '2024-01-25' and event_id % 50 <> 0 group by 1, 2)
  select collector, status, sum(n)::bigint as events from (select * from live union all select * from old) group by 1, 2""")
def archive_totals(spark, sf_dir):
    """Totals of archived days without the live ones and without ids still pending, and live counts."""
    obs = observations(spark, sf_dir).withColumn("day", F.to_date("ts"))
    totals = obs.groupBy("day", "collector", "status").agg(F.count_distinct("event_id").alias("n"))
    pending = obs.where("event_id % 50 = 0 and ts < timestamp_ntz '2024-01-25 00:00:00'").groupBy("collector", "status").agg((-F.count_distinct("event_id")).alias("n"))
    old, live = totals.where("day < date '2024-01-25'"), totals.where("day >= date '2024-01-25'")
    every = old.drop("day").unionByName(live.drop("day")).unionByName(pending)
    return every.groupBy("collector", "status").agg(F.sum("n").alias("events"))


@R.query("source_inventory", f"""{with_sql('obs')} select collector, count(distinct event_id) as events, count(distinct event_id) filter (status = 'failed') as failed,
  count(distinct event_id) filter (k % 10 = 0) as gaps, count(distinct event_id) filter (k >= 90) as unverifiable, min(ts) as first_seen, max(ts) as last_seen,
  arg_max(array_to_string(json_keys(payload), ','), event_id) as latest_keys from obs where ts::date = date '2024-01-15' group by 1""")
def source_inventory(spark, sf_dir):
    obs = observations(spark, sf_dir).where(F.to_date("ts") == "2024-01-15")
    where = lambda c, name: F.count_distinct(F.when(c, F.col("event_id"))).alias(name)
    k = F.col("k")
    return obs.groupBy("collector").agg(
        F.count_distinct("event_id").alias("events"), where(F.col("status") == "failed", "failed"), where(k % 10 == 0, "gaps"), where(k >= 90, "unverifiable"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by(F.array_join(F.json_object_keys("payload"), ","), "event_id").alias("latest_keys"),
    )


@R.query("identity_conflicts", f"""{with_sql('obs')}, copied as (select ts, event_id, payload, username, event_id as seq from obs
  union all select ts, event_id, payload || case when event_id % 40 = 0 then ' ' else '' end, username || '-b', event_id + 1 from obs where event_id % 20 = 0)
  select ts, event_id, count(distinct payload) as contents, arg_min(username, seq) as username from copied group by 1, 2 having count(distinct payload) > 1""")
def identity_conflicts(spark, sf_dir):
    """Ids that were seen with more than one content; the user of the earliest."""
    obs = observations(spark, sf_dir).select("ts", "event_id", "payload", "username", F.col("event_id").alias("seq"))
    more = obs.where("event_id % 20 = 0").select("ts", "event_id", F.concat("payload", F.when(F.col("event_id") % 40 == 0, " ").otherwise("")).alias("payload"), F.concat("username", F.lit("-b")).alias("username"), (F.col("seq") + 1).alias("seq"))
    every = obs.unionByName(more).groupBy("ts", "event_id").agg(F.count_distinct(F.sha2("payload", 256)).alias("contents"), F.min_by("username", "seq").alias("username"))
    return every.where("contents > 1")


@R.query("outbox_claim", f"""{with_sql('payloads')}, q as (select payload_id, bytes, sum(bytes) over (order by payload_id) as total, row_number() over (order by payload_id) as pos
  from payloads where outbox = 'pending' or (outbox = 'leased' and attempts = 1)) select payload_id, bytes, total::bigint as total, pos from q where pos <= 500 and (total <= 40000 or pos = 1)""")
def outbox_claim(spark, sf_dir):
    due = payloads(spark, sf_dir).where("outbox = 'pending' or (outbox = 'leased' and attempts = 1)")
    return X.claim(due.select("payload_id", "bytes"), 500, 40_000)


@R.query("outbox_metrics", f"{with_sql('payloads')} select outbox, count(*) as n, ((epoch_us({AS_OF_SQL}) - epoch_us(min(received_at))) // 1000000) as oldest_age, max(attempts) as max_attempts from payloads group by 1")
def outbox_metrics(spark, sf_dir):
    found = payloads(spark, sf_dir).groupBy("outbox").agg(F.count("*").alias("n"), F.min("received_at").alias("first"), F.max("attempts").alias("max_attempts"))
    return found.select("outbox", "n", F.expr(f"timestampdiff(second, first, timestamp_ntz '{AS_OF}')").alias("oldest_age"), "max_attempts")


@R.query("distinct_names", f"""{with_sql('obs')} select 'collector' as kind, collector as name from obs union select 'collector', unnest(['clipboard', 'dns', 'file', 'logon'])
  union select * from (select distinct 'user' as kind, username as name from obs order by 2 limit 100)""")
def distinct_names(spark, sf_dir):
    obs = observations(spark, sf_dir)
    usual = spark.createDataFrame([(x,) for x in ("clipboard", "dns", "file", "logon")], "name string")
    names = obs.select(F.col("collector").alias("name")).unionByName(usual).distinct().select(F.lit("collector").alias("kind"), "name")
    users = obs.select(F.col("username").alias("name")).distinct().orderBy("name").limit(100)
    return names.unionByName(users.select(F.lit("user").alias("kind"), "name"))


@R.query("page_counts", f"{with_sql('obs')} select count(*) as n, count(distinct event_id) as events, count(distinct payload_id) as payloads from obs where status <> 'success'")
def page_counts(spark, sf_dir):
    obs = observations(spark, sf_dir).where("status <> 'success'")
    return obs.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.count_distinct("payload_id").alias("payloads"))

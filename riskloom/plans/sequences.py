"""Queries of keystroke sequences, streaming ingest, archive days, and views over several tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import keystrokes as K
from riskloom.plans.registry import Registry
from riskloom.sources.files import shared_folder
from riskloom.sources.views import observations, payloads, risk_events, snapshot_bodies, with_sql
from riskloom.streaming import ingest as S

R = Registry()
QUERIES, SQL = R.queries, R.sql

# A user's n-th row shows the pairs 3 n to 3 n + 5; every fifth row shows what the one before showed; every eleventh pair can't be.
_KS = f"""{with_sql('obs')}, r as (select username, agent_id, event_id, row_number() over (partition by username order by event_id) - 1 as n from obs),
ks as (select *, 3 * (n - n // 5) as first from r),
ps as (select *, list_transform(range(first, first + 6), lambda i: [case when i % 11 = 5 then 2000.0 else i * 7 % 300 + 1.0 end, i * 13 % 900 + 0.0]) as every from ks) """


def snapshots_of_keys(spark, sf_dir):
    obs = observations(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("username").orderBy("event_id")) - 1
    rows = obs.select("username", "agent_id", "event_id", n.alias("n")).withColumn("first", 3 * (F.col("n") - F.floor(F.col("n") / 5)))
    dwell = lambda i: F.when(i % 11 == 5, 2000.0).otherwise(i * 7 % 300 + 1.0)
    pairs = F.transform(F.sequence(F.col("first"), F.col("first") + 5), lambda i: F.array(dwell(i), (i * 13 % 900).cast("double")))
    return rows.withColumn("keystroke_timings", F.to_json(pairs))


@R.query("keystroke_timings", _KS + "select event_id, array_to_string(list_transform(list_filter(every, lambda p: p[1] <= 1000), lambda p: p[1]::bigint || ':' || p[2]::bigint), ';') as pairs from ps")
def keystroke_timings(spark, sf_dir):
    pairs = K.timings(F.col("keystroke_timings"), [])
    whole = F.transform(pairs, lambda p: F.concat(p["dwell"].cast("long").cast("string"), F.lit(":"), p["flight"].cast("long").cast("string")))
    return snapshots_of_keys(spark, sf_dir).select("event_id", F.array_join(whole, ";").alias("pairs"))


@R.query("keystroke_flat_columns", f"{with_sql('obs')} select event_id, array_to_string(list_filter([case when k % 4 <> 0 and k < 1000 then (k + 1) || ':' || k end, case when k % 4 >= 2 and k <= 5000 then '5:' || k end], lambda x: x is not null), ';') as pairs from obs")
def keystroke_flat_columns(spark, sf_dir):
    """Timings from columns 'dwell;flight': cells that are empty, not two numbers or out of range are left out."""
    obs = observations(spark, sf_dir)
    cells = [F.expr(x) for x in ("case when k % 4 = 0 then '0;1' else concat(k + 1, ';', k) end", "case when k % 4 < 2 then 'x' else concat('5;', k) end", "'1;2;3'", "cast(null as string)")]
    whole = F.transform(K.timings(F.lit(None).cast("string"), cells), lambda p: F.concat(p["dwell"].cast("long").cast("string"), F.lit(":"), p["flight"].cast("long").cast("string")))
    return obs.select("event_id", F.array_join(whole, ";").alias("pairs"))


def streams(spark, sf_dir):
    """The identities' streams, stitched once: what reads them more than once reads what was written."""
    rows = snapshots_of_keys(spark, sf_dir).withColumn("pairs", K.timings(F.col("keystroke_timings"), []))
    made, path = K.streams(rows, "username", "event_id"), f"{_shared(spark)}/keys"
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


_STREAMS = _KS + ", st as (select * from (select username as identity, len(list_filter(range(0, (max(first) + 6)::bigint), lambda i: i % 11 <> 5)) as keys from ks group by 1) where keys >= 20) "


@R.query("keystroke_streams", _STREAMS + "select identity, keys from st")
def keystroke_streams(spark, sf_dir):
    return streams(spark, sf_dir).select("identity", F.size("dwell").cast("long").alias("keys"))


@R.query("keystroke_windows", _STREAMS + "select identity, (10 * w)::int as start, ((10 * w + (10 * w + 5) // 10) * 7 % 300 + 1)::bigint as first_dwell from (select identity, unnest(range(0, (keys - 20) // 10 + 1)) as w from st)")
def keystroke_windows(spark, sf_dir):
    return K.windows(streams(spark, sf_dir)).select("identity", "start", F.col("dwell")[0].cast("long").alias("first_dwell"))


@R.query("keystroke_splits", _STREAMS + """, l as (select identity, row_number() over (order by identity) - 1 as label, count(*) over () as n from st)
select identity, label, case when label < greatest(1, floor(n * 0.70)) then 'train' when label < greatest(1, floor(n * 0.70)) + greatest(1, floor(n * 0.15)) then 'val' else 'test' end as split from l""")
def keystroke_splits(spark, sf_dir):
    return K.splits(streams(spark, sf_dir).select("identity"))


# Keys of a stream before its first so many pairs do not matter here: only lengths do, and whose probes an impostor shows.
_SIDES = """, sd as (select identity, keys, floor(keys * 0.60)::bigint as cut from st where keys >= 80),
wn as (select identity, 'enroll' as kind, (cut - 20) // 10 + 1 as windows, cut as keys from sd union all select identity, 'genuine', (keys - cut - 20) // 10 + 1, keys - cut from sd),
ok as (select * from wn qualify min(windows) over (partition by identity) >= 3) """


@R.query("keystroke_verification", _STREAMS + _SIDES + """select identity, kind, windows, (windows * (windows - 1) // 2 * 10)::bigint as starts from ok
union all select identity, 'impostor', windows, null from ok where kind = 'genuine' and (select count(distinct identity) from ok) > 1""")
def keystroke_verification(spark, sf_dir):
    """Windows of each kind; impostors' probes always come from another identity (a row of the wrong kind else)."""
    v = K.verification(streams(spark, sf_dir))
    own = (F.col("kind") == "impostor") == (F.col("source") != F.col("identity"))
    starts = F.when(F.col("kind") != "impostor", F.sum("start"))
    return v.withColumn("kind", F.when(own, F.col("kind")).otherwise("wrong")).groupBy("identity", "kind").agg(F.count("*").alias("windows"), starts.cast("long").alias("starts"))


@R.query("keystroke_protocol", _STREAMS + """select case when n >= 4 then 'open-set' else 'temporal' end as protocol, n - greatest(2, floor(n * 0.30))::bigint as train, greatest(2, floor(n * 0.30))::bigint as bench, keys, 0::bigint as both
from (select count(*) as n, sum(keys)::bigint as keys from st) where n >= 4""")
def keystroke_protocol(spark, sf_dir):
    """How many identities train and are held out, with all keys, and how many are on both sides (none)."""
    p = K.protocol(streams(spark, sf_dir)).groupBy("protocol", "identity").agg(F.collect_set("side").alias("sides"), F.sum(F.size("dwell")).alias("keys"))
    of = lambda side: F.count_if(F.array_contains("sides", side))
    return p.groupBy("protocol").agg(of("train").alias("train"), of("bench").alias("bench"), F.sum("keys").alias("keys"), F.count_if(F.size("sides") > 1).alias("both"))


@R.query("keystroke_metrics", f"""{with_sql('obs')} select agent_id, mean_dwell_time_ms, mean_flight_time_ms, typing_speed_cpm, min(ts) as timestamp from (select agent_id, ts, case when k % 3 <> 0 then (k % 40)::double end as mean_dwell_time_ms,
  case when k % 3 <> 0 and k % 5 <> 0 then (k % 7)::double end as mean_flight_time_ms, case when k % 6 = 3 then 200.0::double end as typing_speed_cpm from obs) where coalesce(mean_dwell_time_ms, mean_flight_time_ms, typing_speed_cpm) is not null group by 1, 2, 3, 4""")
def keystroke_metrics(spark, sf_dir):
    made = {"mean_dwell_time_ms": "case when k % 3 <> 0 then cast(k % 40 as double) end", "mean_flight_time_ms": "case when k % 3 <> 0 and k % 5 <> 0 then cast(k % 7 as double) end", "typing_speed_cpm": "case when k % 6 = 3 then 200.0D end"}
    return K.metrics(observations(spark, sf_dir).select("agent_id", F.col("ts").alias("timestamp"), *(F.expr(x).alias(n) for n, x in made.items())))


# -- streams, archives -----------------------------------------------------------------------------


def _shared(spark) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"


@R.query("stream_ingest", f"""{with_sql('obs')}, p as (select payload_id, arg_min(agent_id, event_id) as agent_id, count(*) as n from obs group by 1)
select payload_id::varchar as payload_id, agent_id, n as collectors from p where payload_id % 53 <> 0 and payload_id % 41 <> 0""")
def stream_ingest(spark, sf_dir):
    """Snapshots written as files, each twice, some broken, and taken in by micro-batches: what was accepted, once each."""
    top, lines = _shared(spark), snapshot_bodies(spark, sf_dir, broken=False).select(F.col("body").alias("value"))
    lines.unionByName(lines).write.text(f"{top}/in")
    S.drain(S.read(spark, f"{top}/in"), f"{top}/out", f"{top}/state")
    return S.table(spark, f"{top}/out", "accepted").select("payload_id", "agent_id", F.size("collectors").cast("long").alias("collectors"))


@R.query("stream_dead_letters", f"""{with_sql('obs')}, p as (select payload_id as p from obs group by 1), r as (select p, case when p % 59 = 0 then 'unreadable'
  else array_to_string(list_filter([case when p % 43 = 0 then 'schema' end, case when p % 53 = 0 then 'agent_id' end, case when p % 37 = 0 then 'unsupported_protocol' end, case when p % 41 = 0 then 'payload' end, case when p % 47 = 0 then 'collector_count' end], lambda x: x is not null), ',') end as reason from p)
select reason, count(*) as lines from (select reason from r where reason <> '' union all select 'conflict' from r where reason = '' and p % 6 = 0) group by 1""")
def stream_dead_letters(spark, sf_dir):
    """Broken snapshots, and ids that come twice with different content, by reason."""
    top, lines = _shared(spark), snapshot_bodies(spark, sf_dir)
    whole = F.expr("payload_id % 6 = 0 and payload_id % 59 != 0 and payload_id % 43 != 0 and payload_id % 53 != 0 and payload_id % 37 != 0 and payload_id % 41 != 0 and payload_id % 47 != 0")
    other = lines.where(whole).withColumn("body", F.regexp_replace("body", '"hostname":"HOST-', '"hostname":"COPY-'))
    lines.unionByName(other).select(F.col("body").alias("value")).write.text(f"{top}/in")
    S.drain(S.read(spark, f"{top}/in"), f"{top}/out", f"{top}/state")
    return S.table(spark, f"{top}/out", "dead").groupBy("reason").agg(F.count("*").alias("lines"))


@R.query("late_arrivals", f"""{with_sql('obs')} select event_id, coalesce(seen > max(seen) over (partition by agent_id order by event_id rows between unbounded preceding and 1 preceding), true) as on_time
  from (select event_id, agent_id, ts - (case when k % 5 = 0 then interval 2 hour else interval 0 hour end) as seen from obs)""")
def late_arrivals(spark, sf_dir):
    """Which observations a baseline takes: those after all that their agent had shown when they came."""
    obs = observations(spark, sf_dir).withColumn("seen", F.expr("ts - case when k % 5 = 0 then interval 2 hours else interval 0 hours end"))
    return S.on_time(obs, "agent_id", "event_id", "seen").select("event_id", "on_time")


@R.query("archive_days", f"""{with_sql('obs')}, c as (select ts::date as day, event_id // 1000 as chunk, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as digest from (select *, event_id || '|' || collector || '|' || status || '|' || k as line from obs) group by 1, 2)
select day, sum(n)::bigint as rows, count(*) as chunks, list_reduce(list(digest order by chunk), lambda a, x: sha256(a || x)) as chain from c group by 1""")
def archive_days(spark, sf_dir):
    """Each day sealed: its rows counted, its chunks' digests chained."""
    return S.archive(observations(spark, sf_dir), F.to_date("ts"), "event_id", ["event_id", "collector", "status", "k"])


# -- views over several tables ---------------------------------------------------------------------


@R.query("raw_page", f"""{with_sql('obs', 'payloads')} select o.event_id, o.collector, p.received_at, p.hostname as sent_by from (select * from obs where username = 'user-7' order by ts desc, event_id desc limit 50) o left join payloads p using (payload_id)""")
def raw_page(spark, sf_dir):
    """A page of a user's observations with what their snapshots say: the page first, then the join."""
    page = observations(spark, sf_dir).where("username = 'user-7'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    sent = payloads(spark, sf_dir).select("payload_id", "received_at", F.col("hostname").alias("sent_by"))
    return page.join(sent, "payload_id", "left").select("event_id", "collector", "received_at", "sent_by")


@R.query("replay_hosts", f"""{with_sql('risk')}, s as (select agent_id, max(risk_score) as peak, arg_max(risk_score, (created_at, risk_id)) as live, max(created_at) as live_at from risk where created_at >= timestamp '2024-01-20' group by 1),
d as (select agent_id, max(risk_score) as score from risk where created_at < timestamp '2024-01-20' group by 1), q as (select agent_id, row_number() over (order by score desc, agent_id) as rank from d qualify rank <= 10)
select d.agent_id, d.score, q.rank, s.live, s.peak, s.live_at from d left join q using (agent_id) left join s using (agent_id)""")
def replay_hosts(spark, sf_dir):
    """Each host's score, its place in the queue if any, its latest live score and the live peak."""
    risk, since = risk_events(spark, sf_dir), F.expr("created_at >= timestamp_ntz'2024-01-20'")
    scores = risk.where(~since).groupBy("agent_id").agg(F.max("risk_score").alias("score"))
    queue = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "agent_id")).cast("long")).where("rank <= 10").select("agent_id", "rank")
    live = risk.where(since).groupBy("agent_id").agg(F.max_by("risk_score", F.struct("created_at", "risk_id")).alias("live"), F.max("risk_score").alias("peak"), F.max("created_at").alias("live_at"))
    return scores.join(queue, "agent_id", "left").join(live, "agent_id", "left")


@R.query("usb_evidence", f"""{with_sql('obs')} select payload_id, count(*) filter (k % 3 = 0 and k % 4 in (0, 1, 2)) as transfers from obs group by 1""")
def usb_evidence(spark, sf_dir):
    """Creations, writes and copies on the removable drive, counted as transfers while a device is connected."""
    path = F.when(F.expr("k % 3 = 0"), F.concat(F.lit("e:\\docs\\"), F.col("k").cast("string"))).otherwise("C:\\x")
    op = F.element_at(F.array(F.lit("create"), F.lit("WRITE"), F.lit("Copy"), F.lit("DELETE")), (F.col("k") % 4 + 1).cast("int"))
    moved = F.upper("path").startswith("E:\\") & F.upper("op").isin("CREATE", "WRITE", "COPY")
    return observations(spark, sf_dir).select("payload_id", path.alias("path"), op.alias("op")).groupBy("payload_id").agg(F.count_if(moved).alias("transfers"))

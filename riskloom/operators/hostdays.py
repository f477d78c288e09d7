"""Host-days from activity: the forty features of each agent and day, by what each kind of record allows to add up.

``activity`` has a row a record: event_id, agent_id, hostname, username, ts, kind, item (the PC, device, file, domain or address), amount,
mark and mark2 (what the kind says of it), and rows ``heartbeat:<sensor>`` of the sensors that were alive. Records are told apart by event_id and kind,
so replays count once.

- Counts are sums of records or amounts; gauges are means and peaks.
- Counters that grow over the day and start anew at midnight or a reboot are sums of their rises; after a fall the value itself is the rise.
- A session runs from a logon to the user's next logon or logoff on the host, at most to the day's end.
- New is a file or domain on the day on which its host first shows it: the least day of each (agent, item), one grouping and no look back.
- Entropies are in bits, from counts of items that have been added up before they meet their day.

A sensor without a heartbeat on a day makes its features null, never zero; a living one without records makes them zero. A day without any
row is not there. Null items count as none for distinct, new and entropy. Rows of a large host are added up by item before
they meet, so no host is one task's list. Records, told apart, and the days lie in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.daily import FEATURES
from riskloom.sources.files import shared_folder

#: The sensors and the features that come from each.
SENSORS = {
    "logon": FEATURES[:8], "usb": FEATURES[8:12], "file": FEATURES[12:18], "http": (*FEATURES[18:24], "outbound_attachment_count"), "process": FEATURES[24:28],
    "network": ("bytes_sent", "bytes_received", "external_connection_count", "unique_remote_ip_count", "dns_query_count"),
    "edr": ("clipboard_copy_count", "lsass_handle_request_count", "memory_dump_attempt_count", "decoy_access_count", "wmi_query_count", "named_pipe_event_count"),
}
#: Features that are the sum of one kind's amounts.
SUMMED = {
    "clipboard_copy_count": "clipboard", "lsass_handle_request_count": "lsass", "memory_dump_attempt_count": "memory_dump", "decoy_access_count": "decoy", "wmi_query_count": "wmi",
    "named_pipe_event_count": "pipe", "dns_query_count": "dns", "outbound_attachment_count": "attachment",
}
#: Hours of the day before and from which something is after hours.
OPENS, CLOSES = 7, 19
FILES, KEYS = ("file", "file_delete"), ["agent_id", "review_date"]


def sessions(activity: DataFrame) -> DataFrame:
    """(agent_id, review_date, seconds) of each logon's session."""
    on = activity.where(F.col("kind").isin("logon", "logoff")).select("agent_id", "username", "ts", "event_id", "kind")
    w = Window.partitionBy("agent_id", "username").orderBy("ts", "event_id")
    ends = F.least(F.coalesce(F.lead("ts").over(w), F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz")), F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz"))
    timed = on.withColumn("ends", ends).where("kind = 'logon'")
    return timed.select("agent_id", F.to_date("ts").alias("review_date"), (F.expr("timestampdiff(microsecond, ts, ends)") / 1_000_000).alias("seconds"))


def rises(activity: DataFrame, *kinds: str) -> DataFrame:
    """(agent_id, review_date, kinds): how much each counter has grown on each day; null where it has no record."""
    rows = activity.where(F.col("kind").isin(*kinds)).select("agent_id", F.to_date("ts").alias("review_date"), "kind", "ts", "event_id", "amount")
    before = F.coalesce(F.lag("amount").over(Window.partitionBy(*KEYS, "kind").orderBy("ts", "event_id")), F.lit(0.0))
    grown = rows.withColumn("d", F.when(F.col("amount") >= before, F.col("amount") - before).otherwise(F.col("amount")))
    return grown.groupBy(*KEYS).agg(*(F.sum(F.when(F.col("kind") == k, F.col("d"))).alias(k) for k in kinds))


def _entropy(kind: str) -> Column:
    """From rows (kind, n) of a day's items: log2 of the total less the mean log2 of their counts."""
    n = F.when((F.col("class") == kind) & F.col("item").isNotNull(), F.col("n"))
    total = F.sum(n)
    return F.coalesce(F.greatest(F.lit(0.0), F.round(F.log2(total) - F.sum(n * F.log2(n)) / total, 9)), F.lit(0.0))


def told_apart(rows: DataFrame, path: str, ids: DataFrame | None = None) -> DataFrame:
    """``rows`` with one of each event_id and kind; written anew, to ``path``, only where any repeat.

    To drop repeats outright sorts all rows, with all their columns. Repeats are few: hashes of the keys are counted, and only rows whose
    hash comes twice are dealt out and sorted. Hashes that two keys share bring more rows there, and lose none.
    ``ids``: event_id of each event that rows were made from, none of which gives two rows of a kind; these are fewer, and are counted in place of the rows.
    """
    key = F.xxhash64("event_id", *(["kind"] if ids is None else [])).alias("__key")
    spark, again = rows.sparkSession, (rows if ids is None else ids).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select("__key")
    again.write.parquet(f"{path}-again")
    again = spark.read.schema(again.schema).parquet(f"{path}-again")
    if again.isEmpty():
        return rows
    keyed = rows.select("*", key)
    once, twice = keyed.join(again, "__key", "left_anti"), keyed.join(again, "__key", "left_semi").dropDuplicates(["event_id", "kind"])
    once.unionByName(twice).select(*rows.columns).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def produce(activity: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(agent_id, hostname, review_date, missing_sensors, the forty features); ``ids`` as in ``told_apart``."""
    spark, top = activity.sparkSession, f"{shared_folder(activity.sparkSession)}/hostdays-{uuid.uuid4().hex[:12]}"
    # five steps read the records: they are made and told apart once, the steps read their own columns of what is written
    activity.write.parquet(f"{top}/all")
    rows = told_apart(spark.read.schema(activity.schema).parquet(f"{top}/all"), f"{top}/records", ids)
    late = (F.hour("ts") < OPENS) | (F.hour("ts") >= CLOSES)
    kind = F.when(F.col("kind").isin(*FILES), "file").when(F.col("kind").startswith("heartbeat:"), "heartbeat").otherwise(F.col("kind"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    # a row for each day's items: what is counted further is added up here first
    # the host's name is a key before it is a least value: a least text would sort all records, sums of numbers are hashed
    named = rows.groupBy("agent_id", F.to_date("ts").alias("review_date"), kind.alias("class"), "item", "hostname").agg(
        F.count("*").alias("n"), count(late).alias("late"), count(F.col("mark")).alias("marked"), count(F.col("mark2")).alias("marked2"), count(F.col("kind") == "file_delete").alias("deleted"),
        F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"), F.max("amount").alias("peak"),
    )
    items = named.groupBy(*KEYS, "class", "item").agg(*(F.sum(c).alias(c) for c in ("n", "late", "marked", "marked2", "deleted", "amount")), F.max("peak").alias("peak"), F.min("hostname").alias("hostname"))
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col("class") == k, F.col(c))), F.lit(0)).cast("double")
    some = lambda k, c=None: F.count_if((F.col("class") == k) & F.col("item").isNotNull() & (F.lit(True) if c is None else F.col(c) > 0)).cast("double")
    share = lambda part, k: F.coalesce(F.nullif(of(part, k), F.lit(0.0)) / F.nullif(of("n", k), F.lit(0.0)), F.lit(0.0))
    made = {
        "successful_logons": of("n", "logon"), "failed_logons": of("n", "failed_logon"), "after_hours_logon_ratio": share("late", "logon"), "unique_pc_count": some("logon"), "pc_access_entropy": _entropy("logon"),
        "usb_connect_count": of("n", "usb_connect"), "usb_disconnect_count": of("n", "usb_disconnect"), "after_hours_usb_ratio": share("late", "usb_connect"), "distinct_usb_devices": some("usb_connect"),
        "file_access_count": of("n", "file"), "unique_filename_count": some("file"), "file_delete_count": of("deleted", "file"), "file_access_entropy": _entropy("file"), "protected_file_touch_count": of("marked", "file"),
        "http_request_count": of("n", "http"), "unique_domain_count": some("http"), "external_domain_ratio": share("marked", "http"), "domain_access_entropy": _entropy("http"), "file_sharing_visit_count": of("marked2", "http"),
        "mean_process_count": F.coalesce(of("amount", "process") / F.nullif(of("n", "process"), F.lit(0.0)), F.lit(0.0)), "peak_process_count": F.coalesce(F.max(F.when(F.col("class") == "process", F.col("peak"))), F.lit(0.0)),
        "admin_process_count": of("marked", "process"), "temp_exec_count": of("marked2", "process"), "external_connection_count": of("marked", "connection"), "unique_remote_ip_count": some("connection", "marked"),
    } | {name: of("amount", k) for name, k in SUMMED.items()}
    alive = F.array_sort(F.collect_set(F.when(F.col("class") == "heartbeat", F.col("item"))))  # at most as many as there are sensors
    days = items.groupBy(*KEYS).agg(F.min("hostname").alias("hostname"), alive.alias("__alive"), *(c.alias(n) for n, c in made.items()))
    first = items.where(F.col("class").isin("file", "http") & F.col("item").isNotNull()).groupBy("agent_id", "class", "item").agg(F.min("review_date").alias("review_date"))
    fresh = first.groupBy(*KEYS).agg(count(F.col("class") == "file").cast("double").alias("new_filename_count"), count(F.col("class") == "http").cast("double").alias("new_domain_count"))
    at = sessions(rows).groupBy(*KEYS).agg(F.least(F.lit(86400.0), F.sum("seconds")).alias("interactive_duration_seconds"), F.avg("seconds").alias("mean_session_duration_seconds"))
    for more in (fresh, at, rises(rows, "bytes_sent", "bytes_received")):
        days = days.join(more, KEYS, "left")
    days = days.withColumn("weekend_activity", (F.weekday("review_date") >= 5).cast("double"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, SENSORS)), "__alive"))
    of_sensor = {f: s for s, fs in SENSORS.items() for f in fs}
    told = [F.when(F.array_contains("__alive", of_sensor[f]), F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in FEATURES]
    out = days.select("agent_id", "hostname", "review_date", missing.alias("missing_sensors"), *told)
    # a row an agent and day: what reads the days more than once does not make them again
    out.write.parquet(f"{top}/days")
    return spark.read.schema(out.schema).parquet(f"{top}/days")

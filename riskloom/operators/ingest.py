"""Snapshots in: validation, age, first-wins identity, observations, features, routing, exports.

A snapshot is a row with ``collectors``, an array of structs (collector, collected_at, hostname,
status, payload, error), and ``summary`` (collector_count, success_count, failed_count).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import content as C
from riskloom.functions.identity import observation_id, uuid5
from riskloom.sources.files import shared_folder

STATUSES, MAX_COLLECTORS = ("success", "failed", "critical", "unsupported"), 100
#: Names of features that stand in for others.
ALIASES = {
    "first_usb_usage_time": ("first_usb_time",), "daily_unique_filename_count": ("unique_filename_count",), "daily_new_filename_count": ("new_filename_count",),
    "daily_http_request_count": ("http_request_count", "http_count"), "daily_unique_domain_count": ("unique_domain_count",), "daily_new_domain_count": ("new_domain_count",),
    "daily_external_domain_ratio": ("external_domain_ratio",), "daily_device_connect_count": ("usb_connect_count",), "daily_unique_pc_count": ("unique_pc_count",),
    "suspicious_url_count": ("watchlisted_url_count",), "persistence_modification_count": ("modifications_detected",),
}


def violations() -> Column:
    """What is wrong with a snapshot, as an array of names; empty where it is well formed."""
    c, empty = F.col("collectors"), lambda x: F.coalesce(x, F.lit("")) == ""
    some = lambda bad: F.exists(c, bad)
    count = lambda *s: F.size(F.filter(c, lambda x: x["status"].isin(*s)))
    tests = {
        "payload_id": empty(F.col("payload_id")), "agent_id": empty(F.col("agent_id")), "collectors": c.isNull(), "collector_limit": F.size(c) > MAX_COLLECTORS,
        "collector_field": some(lambda x: empty(x["collector"]) | x["collected_at"].isNull() | empty(x["hostname"]) | empty(x["status"])),
        "status": some(lambda x: ~x["status"].isin(*STATUSES)), "payload": some(lambda x: (x["status"] == "success") & x["payload"].isNull()),
        "error": some(lambda x: (x["status"] == "failed") & x["error"].isNull()), "collector_count": F.col("summary.collector_count") != F.size(c),
        "success_count": F.col("summary.success_count") != count("success"), "failed_count": F.col("summary.failed_count") != count("failed", "critical"),
        "summary": F.col("summary").isNull(),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))


#: The protocol and the schema that are understood, and the fields that a body must have, in the order in which they are looked at.
PROTOCOL, SCHEMA = "2.0", "insiedr.agent.telemetry.v1"
REQUIRED = {"protocol_version": "STRING", "schema": "STRING", "payload_id": "STRING", "agent_id": "STRING", "hostname": "STRING", "collected_at": "STRING", "collectors": "ARRAY"}


def body_violations(body: Column) -> Column:
    """What is wrong with a snapshot's JSON, as an array of names in the order of the rules; empty where it is well formed.

    The rules of ``violations`` for JSON of any shape: fields' types are looked at too, a key with the value null is there.
    What is no JSON object has ``unreadable`` alone. All within the JVM, by Variant: a body is parsed once and each field taken out once, as lambdas'
    arguments; of objects and arrays only what they are is told, not the schema of all that lies in them.
    """
    get = lambda x, path, kind="variant": F.try_variant_get(x, path, kind)
    is_object = lambda x, path: get(x, path, "map<string,variant>").isNotNull()
    schema = lambda y: F.coalesce(F.when(y.isNotNull(), F.schema_of_variant(F.coalesce(y, F.parse_json(F.lit("null"))))), F.lit(""))
    # a field's text: null where nothing or no text lies there
    text = lambda x, path: C.let(get(x, path), lambda y: F.when(schema(y) == "STRING", get(y, "$", "string")))
    number = lambda x, path: C.let(get(x, path), lambda y: F.when(F.regexp_extract(schema(y), "^[A-Z]+", 0).isin("BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN"), get(y, "$", "double")))
    full = lambda t: F.coalesce(t != "", F.lit(False))

    def of_collector(x):
        status = text(x, "$.status")
        fields = reduce(and_, (full(text(x, f"$.{name}")) for name in ("collector", "collected_at", "hostname")))
        return F.struct(is_object(x, "$").alias("object"), fields.alias("fields"), status.alias("status"), get(x, "$.payload").isNull().alias("bare"), is_object(x, "$.error").alias("error"))

    def found(b):
        c, listed = b["c"], F.coalesce(b["c"], F.array().cast(b_type))
        is_, some = (lambda x, *names: F.coalesce(x["status"].isin(*names), F.lit(False))), lambda bad: F.exists(listed, bad)
        of = lambda *names: F.size(F.filter(listed, lambda x: is_(x, *names)))
        told = lambda name, n: ~F.coalesce(b[name] == n.cast("double"), F.lit(False))
        there = {"STRING": lambda k: full(b[k]), "OBJECT": lambda k: b[k], "ARRAY": lambda k: c.isNotNull()}
        tests = {k: ~there[t](k) for k, t in REQUIRED.items()}
        tests |= {
            "unsupported_protocol": full(b["protocol_version"]) & (b["protocol_version"] != PROTOCOL), "unsupported_schema": full(b["schema"]) & (b["schema"] != SCHEMA),
            "collector_limit": F.size(listed) > MAX_COLLECTORS, "collector_object": some(lambda x: ~x["object"]), "collector_field": some(lambda x: ~(x["fields"] & full(x["status"]))),
            "status": some(lambda x: full(x["status"]) & ~is_(x, *STATUSES)), "payload": some(lambda x: is_(x, "success") & x["bare"]), "error": some(lambda x: is_(x, "failed") & ~x["error"]),
            "summary": ~b["summary"], "collector_count": told("n", F.size(listed)), "success_count": told("good", of("success")), "failed_count": told("bad", of("failed", "critical")),
        }
        names = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items())))
        return F.when(b["object"], names).otherwise(F.array(F.lit("unreadable")))

    b_type = "array<struct<object:boolean,fields:boolean,status:string,bare:boolean,error:boolean>>"
    counts = {"n": "collector_count", "good": "success_count", "bad": "failed_count"}
    facts = lambda v: F.struct(
        is_object(v, "$").alias("object"), F.transform(get(v, "$.collectors", "array<variant>"), of_collector).alias("c"), *(text(v, f"$.{k}").alias(k) for k, t in REQUIRED.items() if t == "STRING"),
        *(is_object(v, f"$.{k}").alias(k) for k in dict.fromkeys([*(k for k, t in REQUIRED.items() if t == "OBJECT"), "summary"])), *(number(v, f"$.summary.{k}").alias(n) for n, k in counts.items()),
    )
    return C.let(C.let(F.try_parse_json(body), facts), found)


def in_age(ts: Column, as_of: Column, hours: int = 24, ahead_minutes: int = 5) -> Column:
    return (ts >= as_of - F.expr(f"interval {hours} hours")) & (ts <= as_of + F.expr(f"interval {ahead_minutes} minutes"))


def first_wins(rows: DataFrame, key: str, digest: str, order: list[str]) -> DataFrame:
    """Each key's first row, how often it came again, and whether ever with another content."""
    rest = [c for c in rows.columns if c != key]
    same = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"), (F.count("*") - 1).alias("repeats"), (F.min(digest) != F.max(digest)).alias("conflict"))
    return same.select(key, *(F.col(f"__first.{c}").alias(c) for c in rest), "repeats", "conflict")


def explode_observations(snapshots: DataFrame) -> DataFrame:
    """A row for each collector result, with its number among those of its name and a deterministic id."""
    rows = snapshots.select("payload_id", "agent_id", "username", F.posexplode("collectors").alias("pos", "c"))
    rows = rows.select("payload_id", "agent_id", "username", "pos", "c.*")
    w = Window.partitionBy("payload_id", "collector").orderBy("pos")
    rows = rows.withColumn("ordinal", F.row_number().over(w) - 1)
    return rows.withColumn("id", observation_id(F.col("payload_id").cast("string"), F.col("collector"), F.col("ordinal")))


def explode_features(rows: DataFrame, body: str = "payload") -> DataFrame:
    """A row for each feature of a body that is not null: a number (also of a flag), a text or JSON."""
    spark = rows.sparkSession
    held = [c for c in rows.columns if c != body]
    q = spark.sql(
        f"select {', '.join(f'r.`{c}`' for c in held)}, e.key as feature_name, schema_of_variant(e.value) as kind, e.value as v "
        f"from {{r}} r, lateral variant_explode(try_parse_json(r.`{body}`)) e",
        r=rows,
    )
    kind = F.col("kind")
    flag = kind == "BOOLEAN"
    text = kind == "STRING"
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    q = q.where(kind != "VOID")
    number = F.when(flag, F.try_variant_get("v", "$", "boolean").cast("double")).when(~text & ~nested, F.try_variant_get("v", "$", "double"))
    return q.select(*held, "feature_name", number.alias("feature_number"), F.when(text, F.try_variant_get("v", "$", "string")).alias("feature_text"), F.when(nested, F.to_json("v")).alias("feature_json"))


def feature_value() -> Column:
    """A feature as text: its number, else its text, else its JSON."""
    return F.coalesce(F.col("feature_number").cast("string"), F.col("feature_text"), F.col("feature_json"))


def feature_vectors(features: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A map of features for each key; of features of equal name the newest wins."""
    newest = features.groupBy(*keys, "feature_name").agg(F.max_by("feature_number", F.struct(*order)).alias("v"))
    return newest.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature_name", "v")))).alias("vector"))


def feature_matrix(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Named features as columns, missing ones as zero."""
    wide = features.groupBy(*keys).pivot("feature_name", names).agg(F.max("feature_number"))
    return wide.na.fill(0.0, names)


def fill_aliases(features: Column) -> Column:
    """A map of features with canonical names where only another name was given."""
    found = {name: F.coalesce(*(features[o] for o in others)) for name, others in ALIASES.items()}
    more = F.map_from_entries(F.array_compact(F.array(*(F.when(features[n].isNull() & v.isNotNull(), F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, v in found.items()))))
    return F.map_concat(F.map_filter(features, lambda k, v: v.isNotNull() | ~F.map_contains_key(more, k)), more)


def deletions(features: Column) -> Column:
    """Deletions among the sampled operations of a map; null where it has none or counts them itself."""
    ops = F.filter(F.map_entries(features), lambda e: e["key"].startswith("integrity_events_") & e["key"].endswith("_op") & (F.coalesce(e["value"], F.lit("")) != ""))
    gone = F.size(F.filter(ops, lambda e: F.upper(F.trim(e["value"])).isin("DELETE", "DELETION"))).cast("double")
    own = features["file_delete_count"].isNotNull() | features["daily_file_delete_count"].isNotNull()
    return F.when(~own & (F.size(ops) > 0), gone)


def numeric(text: Column) -> Column:
    """A number, or a time of day 'HH:MM' as hours; what is neither counts as 0."""
    clock = F.regexp_extract(F.trim(text), "^(\\d{1,2}):(\\d{2})$", 1)
    minute = F.regexp_extract(F.trim(text), "^(\\d{1,2}):(\\d{2})$", 2)
    number = F.trim(text).try_cast("double")
    return F.coalesce(F.when(number.isNotNull() & ~F.isnan(number), number), F.when(clock != "", clock.cast("double") + minute.cast("double") / 60.0), F.lit(0.0))


#: The counts that accesses are made of where none are counted themselves, each with its other name.
ACCESSES = (("daily_file_open_count", "file_open_count"), ("daily_file_write_count", "file_write_count"), ("daily_file_delete_count", "file_delete_count"))


def derived(rows: DataFrame, features: str) -> DataFrame:
    """``rows`` with a map of features completed: aliases filled, deletions counted, and accesses made of opened, written and deleted files where it counts none.

    Each step is a column of its own, so the plan holds each once.
    """
    has = lambda *names: F.exists(F.array(*map(F.lit, names)), lambda n: F.map_contains_key(F.col("__filled"), n))
    held = F.col("__filled")
    more = lambda name, value: F.map_concat(held, F.create_map(F.lit(name), value.cast("string")))
    rows = rows.withColumn("__filled", fill_aliases(F.col(features))).withColumn("__gone", deletions(held))
    rows = rows.withColumn("__filled", F.when(F.col("__gone").isNotNull(), more("file_delete_count", F.col("__gone"))).otherwise(held))
    rows = rows.withColumns({f"__part_{i}": F.when(F.map_contains_key(held, a), numeric(held[a])).when(F.map_contains_key(held, b), numeric(held[b])).otherwise(0.0) for i, (a, b) in enumerate(ACCESSES)})
    rows = rows.withColumn("__made", ~has("file_access_count") & has(*(n for pair in ACCESSES for n in pair)))
    total = F.col("__part_0") + F.col("__part_1") + F.col("__part_2")
    return rows.withColumn(features, F.when(F.col("__made"), more("file_access_count", total)).otherwise(held)).drop("__filled", "__gone", "__made", *(f"__part_{i}" for i in range(3)))


# -- interceptors, routes --------------------------------------------------------------------------


class Interceptors:
    """Ordered steps over snapshots' rows: of tables (``apply``: one that is required ends the job if it can't be planned, others are left out) and of bodies (``examine``)."""

    def __init__(self) -> None:
        self.steps: list[tuple[int, str, bool, Callable, bool]] = []

    def register(self, order: int, name: str, required: bool = False, rowwise: bool = False):
        """A step over the table; one of equal name takes the other's place."""

        def add(f):
            self.steps = sorted([*(s for s in self.steps if s[1] != name), (order, name, required, f, rowwise)], key=lambda s: s[:2])
            return f

        return add

    def register_rows(self, order: int, name: str, required: bool = False):
        """A step over one body: a function of a dict that gives a dict, or None to drop the row."""
        return self.register(order, name, required, rowwise=True)

    def examine(self, rows: DataFrame, body: str = "payload") -> DataFrame:
        """``rows`` with bodies as the row-wise steps leave them, ``dropped_by`` (the step that dropped it) and ``failed_in``, ``failure`` (the step that raised, and what).

        A step that raises leaves the body as it was and ends the row's way; if it is required the job ends, so nothing unsanitised is written.
        A body that is no JSON object fails in the first step. Rows go through all steps in one pass; in Arrow batches, since steps are the caller's Python.
        """
        steps = [(name, required, f) for _, name, required, f, rowwise in self.steps if rowwise]

        def one(text):
            name = None
            try:
                value = json.loads(text) if steps and text is not None else None
                for name, required, f in steps if value is not None else ():
                    try:
                        value = f(value)
                    except Exception as e:
                        if required:
                            raise RuntimeError(f"required interceptor {name} failed: {e}") from e
                        return text, None, name, f"{type(e).__name__}: {e}"
                    if value is None:
                        return text, name, None, None
                return (text if value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False)), None, None, None
            except ValueError as e:
                if steps and steps[0][1]:
                    raise RuntimeError(f"required interceptor {steps[0][0]} failed: {e}") from e
                return text, None, steps[0][0] if steps else None, f"{type(e).__name__}: {e}"

        def task(batches):
            for b in batches:
                done = [one(t) for t in b[body]]
                yield b.assign(**{body: [d[0] for d in done], "dropped_by": [d[1] for d in done], "failed_in": [d[2] for d in done], "failure": [d[3] for d in done]})

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInPandas(task, f"{fields}, dropped_by string, failed_in string, failure string")

    @staticmethod
    def split(examined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that go on, dead letters with the step's name and what it said)."""
        return examined.where("dropped_by is null and failed_in is null").drop("dropped_by", "failed_in", "failure"), examined.where("failed_in is not null").drop("dropped_by")

    def apply(self, rows: DataFrame) -> DataFrame:
        for _, name, required, step, rowwise in self.steps:
            if rowwise:
                continue
            try:
                rows = step(rows)
            except Exception as e:
                if required:
                    raise RuntimeError(f"interceptor {name} failed") from e
        return rows


INTERCEPTORS = Interceptors()


@INTERCEPTORS.register(10, "secret_scrubber", required=True)
def scrub_bodies(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: C.scrub_json(c) for c in ("payload", "error") if dict(rows.dtypes).get(c) == "string"})


def process_rows(rows: DataFrame, body: str = "payload") -> DataFrame:
    get = lambda *k: F.coalesce(*(F.nullif(F.get_json_object(body, f"$.{x}"), F.lit("")) for x in k))
    number = lambda *k: F.coalesce(get(*k).try_cast("long"), F.lit(0).cast("long"))
    text = lambda *k: F.coalesce(get(*k), F.lit(""))
    kept = rows.where(F.lower("collector").contains("process"))
    return kept.select("event_id", text("process_name", "name").alias("process_name"), number("pid", "process_id").alias("pid"), number("parent_pid", "ppid").alias("parent_pid"), text("command_line", "cmdline").alias("command_line"))


def network_rows(rows: DataFrame, body: str = "payload") -> DataFrame:
    get = lambda *k: F.coalesce(*(F.nullif(F.get_json_object(body, f"$.{x}"), F.lit("")) for x in k))
    name = F.lower("collector")
    kept = rows.where(~name.contains("process") & (name.contains("network") | name.contains("http")))
    port = F.coalesce(get("dest_port", "port").try_cast("long"), F.lit(0).cast("long"))
    return kept.select("event_id", F.coalesce(get("dest_ip", "remote_ip", "host"), F.lit("")).alias("dest_ip"), port.alias("dest_port"), F.coalesce(get("proto"), F.lit("TCP")).alias("proto"), F.coalesce(get("domain"), F.lit("")).alias("domain"))


def tamper_rows(rows: DataFrame) -> DataFrame:
    """A risk row of full score for every sign of tampering; its level follows from the score."""
    bad = rows.where((F.col("collector") == "tamper") | (F.col("status") == "critical"))
    w = Window.partitionBy("payload_id", "collector").orderBy("event_id")
    bad = bad.withColumn("n", F.row_number().over(w) - 1)
    stem = F.concat(F.col("payload_id").cast("string"), F.lit(":risk:"), F.col("collector"))
    key = F.when(F.col("n") > 0, F.concat(stem, F.lit(":"), F.col("n").cast("string"))).otherwise(stem)
    said = F.concat(F.lit("Agent Tamper Alert: Forced termination or tampering detected on "), F.col("hostname"), F.lit("."))
    return bad.select(uuid5(key).alias("id"), "payload_id", F.lit(100.0).alias("risk_score"), C.level(F.lit(100.0)).alias("risk_level"), said.alias("summary"), F.col("ts").alias("created_at"))


# -- columns that the data has ----------------------------------------------------------------------

#: Columns of a dynamic export at most.
COLUMNS = 10_000


def discovered(rows: DataFrame, values: str, most: int = COLUMNS) -> dict[str, bool]:
    """The keys of a column of maps, in order, and whether all of a key's values are numbers: one pass, a row a key, at most ``most`` or an error."""
    pairs = rows.select(F.explode(values).alias("key", "value")).groupBy("key").agg(F.bool_and(F.coalesce("value", F.lit("0")).try_cast("double").isNotNull()).alias("numeric"))
    found = pairs.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different columns")
    return {r.key: r.numeric for r in sorted(found, key=lambda r: r.key)}


def made_once(rows: DataFrame) -> DataFrame:
    """``rows``, written: bodies are taken apart in Python once, not for the names of the columns and for the columns again."""
    path = f"{shared_folder(rows.sparkSession)}/leaves-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dataset(rows: DataFrame, keep: list[str], body: str = "body", most: int = COLUMNS) -> DataFrame:
    """``keep`` and a column of text for every leaf that any body has, named by its path, '' where a body lacks it; columns in order of their names.

    A leaf named like a column of ``keep`` (in any case) comes with ``feature_`` before its name.
    """
    flat = made_once(rows.select(*keep, C.flatten(body).alias("__flat")))
    taken = {k.lower() for k in keep}
    named = {k: k if k.lower() not in taken else f"feature_{k}" for k in discovered(flat, "__flat", most)}
    return flat.select(*keep, *(F.coalesce(F.element_at("__flat", F.lit(k)), F.lit("")).alias(n) for k, n in named.items()))


def matrix(rows: DataFrame, keep: list[str], parameters: str = "parameters", most: int = COLUMNS) -> DataFrame:
    """``keep`` and a column for every key of a map of text: numbers where all its values are (missing: 0.0), else text (missing: '0.0', a number as it prints)."""
    rows = made_once(rows.select(*keep, parameters))
    taken = {k.lower() for k in keep}
    out = []
    for k, numeric in discovered(rows, parameters, most).items():
        v = F.element_at(parameters, F.lit(k))
        number = F.coalesce(v.try_cast("double"), F.when(v.isNull(), F.lit(0.0)))
        out.append((number if numeric else F.coalesce(number.cast("string"), v)).alias(k if k.lower() not in taken else f"feature_{k}"))
    return rows.select(*keep, *out)


def keystroke_export(rows: DataFrame, figures: list[str], body: str = "payload", features: str = "features") -> DataFrame:
    """``rows`` with each figure as text, of the body, else of the features, else '' (zero, false and empty count as none), and the timings as JSON, [] without any."""
    there = lambda c: F.when(~F.coalesce(c.isin("", "false") | (c.try_cast("double") == 0), F.lit(True)), c)
    pick = lambda name: F.coalesce(there(F.get_json_object(body, f"$.{name}")), there(F.get_json_object(features, f"$.{name}")), F.lit(""))
    return rows.withColumns({n: pick(n) for n in figures} | {"keystroke_timings": F.coalesce(F.get_json_object(body, "$.keystroke_timings"), F.lit("[]"))})


#: Names that a snapshot has for itself, not for what it measured.
OWN = ("collectors", "payload_id", "agent_id", "hostname", "username", "collected_at")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parameters(body: pd.Series) -> pd.Series:
    """What a model is trained on, from a snapshot's JSON: the entries of its successful collectors' bodies, of objects in them and of objects in those; the first of a name wins.

    A snapshot without collectors gives its own fields. Values are text: numbers as JSON has them, true and false, lists and deeper objects as JSON; nulls
    are left out. Null for what is no JSON object. In Arrow batches, since the first of a name is told by the order in which the JSON has them.
    """

    def put(found, name, value):
        if value is not None:
            found.setdefault(name, value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False))

    def one(text):
        try:
            snapshot = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if not isinstance(snapshot, dict):
            return None
        found: dict[str, str] = {}
        results = snapshot.get("collectors")
        if not results:
            for name, value in snapshot.items():
                if name not in OWN:
                    put(found, name, value)
        for result in results if isinstance(results, list) else ():
            if not isinstance(result, dict) or result.get("status") != "success" or not isinstance(result.get("payload"), dict):
                continue
            for name, value in result["payload"].items():
                for inner, deeper in value.items() if isinstance(value, dict) else ((name, value),):
                    for last, entry in deeper.items() if isinstance(value, dict) and isinstance(deeper, dict) else ((inner, deeper),):
                        put(found, last, entry)
        return found

    return body.map(one)


def newest_vectors(features: DataFrame, days: int = 16, rows_a_day: int = 128, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """(day, vector) of the newest ``days`` days among the newest ``days`` x ``rows_a_day`` rows of one user's or host's features; of a day's rows of one name the oldest counts."""
    newest = features.where(F.col(ts).isNotNull()).orderBy(F.desc(ts), F.desc(key), "feature_name").limit(days * rows_a_day)
    told = newest.groupBy(F.to_date(ts).alias("day"), "feature_name").agg(F.min_by(feature_value(), F.struct(ts, key)).alias("v"))
    whole = told.groupBy("day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature_name", "v")))).alias("vector"))
    return whole.orderBy(F.desc("day")).limit(days)

"""Adaptive baselines of users, role cohorts and hosts, in batch form.

A baseline takes at most one observation of an entity an hour. Whether one is taken depends on the one
taken before it: the throttle walks each entity's rows in order. Observations taken are summed up by
day; only days are folded, so a state costs as many steps as there are days, whatever the traffic.

The day of an entity's last observation is still open: it is not part of the mean. Null features are
missing, not zero. Of observations at the same time the one with the smallest id is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.identity import role_of as infer_role  # noqa: F401  the one inference of roles, under its name here

#: Days that the moving average stands for.
DAYS = 14
#: Merged days from which on a baseline is trusted, and observations from which on values are bounded.
MATURE = 5
#: Least deviation: of shares and rates, of a user's other features, of a host's.
FLOOR_RATE, FLOOR_USER, FLOOR_HOST = 0.05, 1.0, 0.5

# Mean and deviation of a feature where neither user nor role has a baseline.
USER_PRIORS = {
    "auth_rate_300s": (0.2, 0.5),
    "auth_rate_3600s": (0.2, 0.5),
    "auth_fail_rate_300s": (0.0, 0.2),
    "edr_auth_events_per_minute_window": (1.0, 2.0),
    "edr_failed_auth_events_per_minute_window": (0.0, 0.5),
    "edr_failed_auth_ratio_window": (0.0, 0.15),
    "unique_workstations_300s": (1.0, 0.5),
    "off_hours_auth_count": (0.0, 0.5),
    "daily_after_hours_logon_ratio": (0.0, 0.15),
    "daily_unique_pc_count": (1.0, 0.5),
    "daily_unique_filename_count": (25.0, 35.0),
    "daily_new_filename_count": (10.0, 25.0),
    "file_access_count": (30.0, 50.0),
    "file_sharing_site_visits": (0.0, 0.5),
    "daily_http_request_count": (60.0, 80.0),
    "daily_external_domain_ratio": (0.25, 0.25),
    "daily_device_connect_count": (0.0, 0.5),
    "bytes_sent": (5_000_000.0, 15_000_000.0),
}


def confidence(samples: Column) -> Column:
    return F.when(samples > 0, F.least(samples / DAYS, F.lit(1.0))).otherwise(0.1)


def std_floor(feature: Column, mean: Column, least: float) -> Column:
    rate = F.lower(feature).rlike("ratio|rate|entropy")
    return F.greatest(F.abs(mean) * 0.1, F.when(rate, FLOOR_RATE).otherwise(least))


def throttle(df: DataFrame, keys: list[str], at: str = "ts", key: str = "payload_id", seconds: int = 3600) -> DataFrame:
    """The rows of ``df`` that a baseline takes: the first of each entity, then each ``seconds`` or more after the one taken.

    One pass over rows in order, with the time last taken as the only state: an entity of any size is a stream in its task, never a list.
    """
    rows = df.select(F.struct(*keys).alias("__entity"), F.unix_micros(F.col(at).cast("timestamp")).alias("__t"), F.col(key).cast("long").alias(key))
    rows = rows.where(F.col("__t").isNotNull()).select(F.to_json("__entity", {"ignoreNullFields": "false"}).alias("__entity"), "__t", key)
    pause = seconds * 1_000_000

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, last = None, 0
        for b in batches:
            taken = []
            for e, t, k in zip(*(b.column(c).to_pylist() for c in ("__entity", "__t", key))):
                if e != entity or t - last >= pause:
                    entity, last = e, t
                    taken.append(k)
            yield pa.RecordBatch.from_pydict({key: pa.array(taken, pa.int64())})

    ordered = rows.repartition("__entity").sortWithinPartitions("__entity", "__t", key)
    return df.join(ordered.mapInArrow(walk, f"`{key}` long"), key, "left_semi")


def tall(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """One row for each feature that an observation has."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def _merge(state, average, feature, least):
    rate = 2.0 / (DAYS + 1.0)
    before = F.coalesce(state["mean"], average)
    mean = (1 - rate) * before + rate * average
    spread = (1 - rate) * F.coalesce(state["std"], std_floor(feature, before, least)) + rate * F.abs(average - before)
    return F.struct(mean.alias("mean"), F.greatest(spread, std_floor(feature, mean, least)).alias("std"), (state["samples"] + 1).alias("samples"))


_EMPTY = "named_struct('mean', cast(null as double), 'std', cast(null as double), 'samples', 0L)"


def _closed_days(taken: DataFrame, entity: str) -> DataFrame:
    """Observations with their day, but for the last day of each entity."""
    dated = taken.withColumn("day", F.to_date("ts"))
    last = dated.groupBy(entity).agg(F.max("day").alias("__last"))
    return dated.join(last, entity).where(F.col("day") < F.col("__last")).drop("__last")


def moving_average(taken: DataFrame, entity: str, features: list[str], least: float = FLOOR_USER) -> DataFrame:
    """(entity, feature, mean, std, samples): the state after the observations ``taken``; none before a day is closed."""
    days = tall(_closed_days(taken, entity), [entity, "day"], features).groupBy(entity, "feature", "day").agg(F.avg("value").alias("average"))
    folded = days.groupBy(entity, "feature").agg(F.sort_array(F.collect_list(F.struct("day", "average"))).alias("days"))
    state = F.aggregate("days", F.expr(_EMPTY), lambda s, d: _merge(s, d["average"], F.col("feature"), least))
    return folded.select(entity, "feature", F.inline(F.array(state)))


def bounded_average(taken: DataFrame, entity: str, features: list[str], least: float = FLOOR_HOST) -> DataFrame:
    """As ``moving_average``, each value held between zero and three deviations above the mean of the days before.

    The bound moves only when a day closes, so a day is one step over its values, of which the throttle leaves 24 at most.
    """
    order = Window.partitionBy(entity).orderBy("ts", "payload_id")
    numbered = taken.withColumn("nth", F.row_number().over(order))
    values = tall(_closed_days(numbered, entity), [entity, "day", "nth"], features)
    days = values.groupBy(entity, "feature", "day").agg(F.sort_array(F.collect_list(F.struct("nth", "value"))).alias("values"))
    folded = days.groupBy(entity, "feature").agg(F.sort_array(F.collect_list(F.struct("day", "values"))).alias("days"))

    def step(state, day):
        top = state["mean"] + 3 * F.greatest(state["std"], std_floor(F.col("feature"), state["mean"], least))
        held = lambda v: F.greatest(F.lit(0.0), F.when((v["nth"] >= MATURE) & top.isNotNull(), F.least(v["value"], top)).otherwise(v["value"]))
        average = F.aggregate(day["values"], F.lit(0.0), lambda s, v: s + held(v)) / F.size(day["values"])
        return _merge(state, average, F.col("feature"), least)

    return folded.select(entity, "feature", F.inline(F.array(F.aggregate("days", F.expr(_EMPTY), step))))


def deviations(df: DataFrame, users: DataFrame, roles: DataFrame, features: list[str]) -> DataFrame:
    """(payload_id, username, feature, z, tier): against the user's own baseline if mature, else the role's, else the prior, else 0.

    ``df`` has payload_id, username and role_name; ``users`` and ``roles`` are states keyed by username and role_name.
    """
    of = lambda t, e, tag: t.where(F.col("samples") >= MATURE).select(e, "feature", F.struct("mean", "std").alias(tag))
    rows = tall(df, ["payload_id", "username", "role_name"], features)
    rows = rows.join(of(users, "username", "own"), ["username", "feature"], "left").join(of(roles, "role_name", "role"), ["role_name", "feature"], "left")
    prior = F.lit(None).cast("struct<mean:double,std:double>")
    for name, (mean, std) in USER_PRIORS.items():
        if name in features:
            prior = F.when(F.col("feature") == name, F.struct(F.lit(mean).alias("mean"), F.lit(std).alias("std"))).otherwise(prior)
    rows = rows.withColumn("base", F.coalesce("own", "role", prior))
    tier = F.when(F.col("own").isNotNull(), "user").when(F.col("role").isNotNull(), "role").when(F.col("base").isNotNull(), "prior").otherwise("none")
    spread = F.greatest("base.std", std_floor(F.col("feature"), F.col("base.mean"), FLOOR_USER))
    z = F.when(F.col("base").isNull(), 0.0).otherwise((F.col("value") - F.col("base.mean")) / spread)
    return rows.select("payload_id", "username", "feature", z.alias("z"), tier.alias("tier"))


#: The features that a user's and a host's baseline are made of.
USER_FEATURES = (
    "daily_unique_filename_count", "daily_new_filename_count", "file_access_count", "file_sharing_site_visits", "daily_http_request_count", "daily_external_domain_ratio",
    "daily_device_connect_count", "bytes_sent",
)
HOST_FEATURES = (
    "unique_workstations_300s", "auth_rate_300s", "edr_auth_events_per_minute_window", "edr_auth_event_count_window", "off_hours_auth_count", "daily_unique_pc_count", "daily_device_connect_count",
)
#: Fixed value: the risk from which on a snapshot teaches no baseline.
ALERTING = 40.0


def selected(df: DataFrame, keep: list[str], features: tuple[str, ...]) -> DataFrame:
    """(keep, feature, value): the features of a baseline that each row has; what is no number is left out."""
    there = [f for f in features if f in df.columns]
    read = df.select(*keep, *(F.nanvl(F.col(f).try_cast("double"), F.lit(None).cast("double")).alias(f) for f in there))
    return tall(read, keep, there)


def teaches_user(risk: Column) -> Column:
    return risk < ALERTING


def teaches_host(risk: Column, auth_anomaly: Column, flags: list[Column]) -> Column:
    """No alert, no burst of logons, none of the surest signs: so an intruder does not teach the host's baseline."""
    calm = (risk < ALERTING) & ~auth_anomaly
    for flag in flags:
        calm = calm & ~flag
    return calm


def rolling_view(state: DataFrame, taken: DataFrame, entity: str, features: list[str]) -> DataFrame:
    """(entity, samples): each entity's features in the order of names with mean, std, samples and how often they were missing on closed days."""
    days = _closed_days(taken, entity).groupBy(entity).agg(*(F.count_if(F.col(f).isNull()).alias(f) for f in features))
    missing = days.select(entity, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("missing")) for f in features))))
    row = F.struct("feature", "mean", "std", "samples", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))
    return state.join(missing, [entity, "feature"], "left").groupBy(entity).agg(F.sort_array(F.collect_list(row)).alias("samples"))

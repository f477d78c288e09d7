"""Scoring that learns as it goes: each snapshot is scored against the baselines that all earlier ones have left, and teaches them if it is calm.

A snapshot's score depends on its user's, its cohort's and its host's baseline, each of which depends on which earlier snapshots were calm.
Walked one by one that is a chain through all rows. Here it is a fixed point: given who was calm, every entity's baseline is an ordered fold of its own
rows (sorted partitions, a task holds one entity's state at a time); given the baselines, all rows are scored at once, which says who was calm;
and so on until nobody's calm changes. A row's verdict depends on rows before it alone, so each round settles at least the
first unsettled row and in practice nearly all: the end is the walk's result, whatever the first guess. Rounds are written to the shared folder.

Rows are taken in the order of arrival (``arrived``, then ``payload_id``), their values dated by ``ts``. A baseline takes at most one row an hour
(of a cohort: one an hour of each member; a member not heard of for 48 hours of the cohort's time is forgotten), and none that lies before the last it took.
The day's values are averaged and merged when a row of another day is taken. A host's values are held between 0 and three deviations above
its mean from the fifth row on. Missing values are counted, never zero. Without username no user or cohort, without agent_id no host is learnt or looked at.
States come in and go out as rows (kind, entity, state), so micro-batches continue where the last one ended.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import uuid
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.baseline import DAYS, FLOOR_HOST, FLOOR_RATE, FLOOR_USER, HOST_FEATURES, MATURE, USER_FEATURES, USER_PRIORS, std_floor, teaches_host, teaches_user
from riskloom.sources.files import shared_folder

#: Mean and deviation of a host's feature without a baseline of its own.
HOST_PRIORS = {"unique_workstations_300s": (1.0, 0.5), "auth_rate_300s": (0.2, 0.5), "edr_auth_events_per_minute_window": (1.0, 2.0), "edr_auth_event_count_window": (1.0, 2.0), "off_hours_auth_count": (0.0, 0.5), "daily_unique_pc_count": (1.0, 0.5), "daily_device_connect_count": (0.0, 0.5)}
HOUR, DAY, FORGOTTEN = 3_600_000_000, 24 * 3_600_000_000, 48 * 3_600_000_000
#: A score may look at rows of the same username and agent_id that lie so far before it by ``ts``.
REACH = 4 * HOUR
STATES = "kind string, entity string, state string"


def floor_of(feature: str, mean: float, least: float) -> float:
    rate = any(part in feature.lower() for part in ("ratio", "rate", "entropy"))
    return max(abs(mean) * 0.1, FLOOR_RATE if rate else least)


@lru_cache(maxsize=1024)
def _day(number: int) -> str:
    return str(date(1970, 1, 1) + timedelta(number))


class Baseline:
    """What one entity has taught so far; the same in a batch, in a stream and in a walk."""

    #: What is no part of the state: it follows from the rest.
    BESIDE = ("kind", "least", "known", "oldest")

    def __init__(self, kind: str, state: str | None = None):
        self.kind, self.least, self.known = kind, FLOOR_HOST if kind == "host" else FLOOR_USER, {}
        self.mean, self.std, self.samples, self.missing, self.sums, self.counts, self.members, self.last, self.day, self.taken = {}, {}, {}, {}, {}, {}, {}, None, None, 0
        if state:
            self.__dict__ |= json.loads(state)
        # the members' times, the oldest first: who is forgotten is found without a look at the others
        self.oldest = [(t, m) for m, t in self.members.items()]
        heapq.heapify(self.oldest)

    def state(self) -> str:
        return json.dumps({k: v for k, v in self.__dict__.items() if k not in self.BESIDE}, sort_keys=True)

    def seen(self, features: tuple[str, ...]) -> list[float | None]:
        """Mean and deviation of each feature that five days or more have been merged of."""
        if features not in self.known:
            self.known[features] = [v for f in features for v in ((self.mean[f], self.std[f]) if self.samples.get(f, 0) >= MATURE else (None, None))]
        return self.known[features]

    def due(self, at: int, member: str | None = None) -> bool:
        """Whether a calm row of this time would be taken."""
        before = self.members.get(member) if self.kind == "role" else self.last
        return before is None or at - before >= HOUR

    def take(self, at: int, values: dict[str, float], member: str | None = None) -> bool:
        """A calm row of time ``at`` (microseconds); whether it was taken."""
        if not self.due(at, member):
            return False
        day = _day(at // DAY)
        if self.day and self.day != day:
            self._merge()
        self.day, self.last, self.taken = day, at, self.taken + 1
        if self.kind == "role":
            self.members[member] = at
            heapq.heappush(self.oldest, (at, member))
            while at - self.oldest[0][0] >= FORGOTTEN:
                t, m = heapq.heappop(self.oldest)
                if self.members.get(m) == t:  # else heard of since
                    del self.members[m]
        for f in self.mean:
            if f not in values:
                self.missing[f] = self.missing.get(f, 0) + 1
        for f, v in values.items():
            if self.kind == "host":
                top = self.mean[f] + 3 * max(self.std[f], floor_of(f, self.mean[f], self.least)) if self.taken >= MATURE and f in self.mean else math.inf
                v = max(0.0, min(v, top))
            self.sums[f], self.counts[f] = self.sums.get(f, 0.0) + v, self.counts.get(f, 0) + 1
        return True

    def _merge(self) -> None:
        rate = 2.0 / (DAYS + 1.0)
        for f, n in self.counts.items():
            average = self.sums[f] / n
            before = self.mean.get(f, average)
            self.mean[f] = (1 - rate) * before + rate * average
            spread = (1 - rate) * self.std.get(f, floor_of(f, before, self.least)) + rate * abs(average - before)
            self.std[f] = max(spread, floor_of(f, self.mean[f], self.least))
            self.samples[f] = self.samples.get(f, 0) + 1
        self.sums, self.counts, self.known = {}, {}, {}


def _keyed(rows: DataFrame, kinds: dict[str, tuple[str, str, tuple[str, ...]]], states: DataFrame | None, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of every kind's entities in the order in which they are walked, an entity's state before its rows; values as v0, v1, ..."""
    width = max(len(features) for _, _, features in kinds.values())
    nothing = {"at": "long", "payload_id": "long", "ts": "long", "calm": "boolean", "member": "string"} | {c: "long" for c in more} | {f"v{i}": "double" for i in range(width)}
    parts = []
    for kind, (entity, calm, features) in kinds.items():
        member = F.col("member") if kind == "role" else F.lit(None).cast("string")
        values = [(F.col(features[i]) if i < len(features) else F.lit(None).cast("double")).alias(f"v{i}") for i in range(width)]
        parts.append(rows.where(F.coalesce(F.col(entity), F.lit("")) != "").select(F.lit(kind).alias("kind"), F.col(entity).alias("entity"), F.col("arrived").alias("at"), "payload_id", "ts", F.col(calm).alias("calm"), member.alias("member"), *more, *values, F.lit(None).cast("string").alias("state")))
    if states is not None:
        parts.append(states.where(F.col("kind").isin(*kinds)).select("kind", "entity", *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()), "state"))
    keyed = reduce(DataFrame.unionByName, parts)
    return keyed.repartition("kind", "entity").sortWithinPartitions("kind", "entity", F.col("at").asc_nulls_first(), "payload_id")


class Walk:
    """Ordered rows, batch by batch: what each has seen of its entity, and each entity's state after its last row. Only calm rows are looked at one by one."""

    def __init__(self, named: dict[str, tuple[str, ...]], told: bool = True):
        self.named, self.told, self.now, self.held, self.ended = named, told, None, None, []

    def end(self) -> list[tuple[str, str, str]]:
        """(kind, entity, state) of the last entity and of those that have ended since they were asked for."""
        if self.held is not None and self.told:
            self.ended.append((*self.now, self.held.state()))
        self.held = None
        return self.ended

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, its rows, their values, what was seen, which of this each row has seen); nan where there is nothing."""
        kinds = batch.column("kind").dictionary_encode()
        codes = kinds.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                kind, part = kinds[lo].as_py(), batch.slice(lo, hi - lo)
                values = np.column_stack([np.empty((hi - lo, 0)), *(part.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(len(self.named[kind])))])
                yield kind, part, values, *self._part(kind, part, values)

    def _part(self, kind: str, part: pa.RecordBatch, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        features, n = self.named[kind], part.num_rows
        entities = part.column("entity").dictionary_encode()
        codes, names = entities.indices.to_numpy(), entities.dictionary.to_pylist()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), n]
        calm = np.flatnonzero(part.column("calm").fill_null(False).to_numpy(zero_copy_only=False) & ~np.isnan(values).all(axis=1))
        places = calm.tolist()
        ts, who = (part.column(c).take(pa.array(calm)).to_pylist() for c in ("ts", "member"))
        rows = values[calm].tolist()
        stated = part.column("state") if part.column("state").null_count < n else None
        starts, seen, nth = [], [], 0
        for lo, hi in zip(cuts, cuts[1:]):
            key = (kind, names[codes[lo]])
            if key != self.now or self.held is None:
                if self.held is not None and self.told:
                    self.ended.append((*self.now, self.held.state()))
                self.now, self.held = key, Baseline(kind, stated[lo].as_py() if stated is not None else None)
            held = self.held
            starts.append(lo)
            seen.append(held.seen(features))
            while nth < len(places) and places[nth] < hi:
                if held.due(ts[nth], who[nth]):
                    held.take(ts[nth], {f: v for f, v in zip(features, rows[nth]) if v == v}, who[nth])
                    if features not in held.known:  # a day has been merged: the next rows see it
                        starts.append(places[nth] + 1)
                        seen.append(held.seen(features))
                nth += 1
        return np.array(seen, dtype=float), np.repeat(np.arange(len(starts)), np.diff([*starts, n]))


def fold(rows: DataFrame, kinds: dict[str, tuple[str, str, tuple[str, ...]]], states: DataFrame | None = None) -> DataFrame:
    """(kind, payload_id, seen) of every row and kind, and (kind, entity, state) after the last row of each entity.

    ``rows``: payload_id long, ts and arrived as microseconds, ``member`` and, for each of ``kinds``, its entity, calm and features.
    All kinds are one shuffle, so that users and hosts are walked while the tasks of the few large cohorts run.
    """
    named = {kind: features for kind, (_, _, features) in kinds.items()}
    schema = pa.schema([("kind", pa.string()), ("payload_id", pa.int64()), ("seen", pa.list_(pa.float64())), ("entity", pa.string()), ("state", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked = Walk(named)

        def ended():
            out, walked.ended = walked.ended, []
            none = [None] * len(out)
            return pa.RecordBatch.from_pydict({"kind": [k for k, _, _ in out], "payload_id": none, "seen": none, "entity": [e for _, e, _ in out], "state": [s for _, _, s in out]}, schema)

        for b in batches:
            for _, part, _, seen, which in walked.parts(b):
                flat, n = seen[which].ravel(), part.num_rows
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * seen.shape[1]), pa.array(flat, mask=np.isnan(flat)))
                out = pa.RecordBatch.from_arrays([part.column("kind"), part.column("payload_id"), lists, pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=schema)
                yield out.filter(part.column("payload_id").is_valid())
            if walked.ended:
                yield ended()
        walked.end()
        yield ended()

    return _keyed(rows, kinds, states).mapInArrow(walk, "kind string, payload_id long, seen array<double>, entity string, state string")


def _felt(z: Column, bounds: tuple[float, float]) -> Column:
    return F.when(z < bounds[0], 0.0).otherwise(F.least(z, F.lit(bounds[1])))


def _far(rows: DataFrame, kinds: dict, states: DataFrame | None, felt: dict[str, tuple[float, float]]) -> DataFrame:
    """(kind, payload_id, sess, z0, z1, ...): how far rows lie from their entities' baselines, as far as it is felt; nan: no value or no mature baseline.

    Left out: a user's row where all is nan, and a cohort's or host's where nothing is felt.
    """
    named = {kind: features for kind, (_, _, features) in kinds.items()}
    width = max(map(len, named.values()))
    least = {kind: np.array([floor_of(f, 0.0, FLOOR_HOST if kind == "host" else FLOOR_USER) for f in features]) for kind, features in named.items()}
    columns = ["kind", "payload_id", "sess", *(f"z{i}" for i in range(width))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked = Walk(named, told=False)
        for b in batches:
            for kind, part, values, seen, which in walked.parts(b):
                mean, std = seen[:, 0::2], seen[:, 1::2]
                spread = np.maximum(std, np.maximum(np.abs(mean) * 0.1, least[kind]))
                low, high = felt["host" if kind == "host" else "user"]
                z = (values - mean[which]) / spread[which]
                z = np.where(z < low, 0.0, np.minimum(z, high))
                told = ~np.isnan(z).all(axis=1) if kind == "user" else (z != 0).any(axis=1)
                told &= part.column("payload_id").is_valid().to_numpy(zero_copy_only=False)
                out = part.select(["kind", "payload_id", "sess"]).filter(pa.array(told))
                z = z[told]
                far = [pa.array(z[:, i]) if i < z.shape[1] else pa.nulls(len(z), pa.float64()) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*out.columns, *far], names=columns)

    return _keyed(rows, kinds, states, ("sess",)).mapInArrow(walk, ", ".join(["kind string", "payload_id long", "sess long", *(f"z{i} double" for i in range(width))]))


def _z(value: Column, mean: Column, std: Column, feature: str, least: float) -> Column:
    return (value - mean) / F.greatest(std, std_floor(F.lit(feature), mean, least))


def deviation(feature: str, value: Column, tiers: list[Column], at: int, prior: tuple[float, float] | None, least: float) -> Column:
    """How far a value lies from the first tier that knows the feature, else from the prior, else 0; null without a value."""
    z = F.lit(0.0) if prior is None else _z(value, F.lit(prior[0]), F.lit(prior[1]), feature, least)
    for seen in reversed(tiers):
        z = F.when(seen[2 * at].isNotNull(), _z(value, seen[2 * at], seen[2 * at + 1], feature, least)).otherwise(z)
    return F.when(value.isNotNull(), z)


def _approach(base: DataFrame, rows: DataFrame, score: Callable[[DataFrame], DataFrame], users: tuple[str, ...], hosts: tuple[str, ...], kinds: dict, states: DataFrame | None, felt: dict[str, tuple[float, float]], write: Callable[[DataFrame, str], DataFrame], forget: Callable[[str], None]) -> tuple[DataFrame, int]:
    """(payload_id, calm_user, calm_host), rounds: a first guess that is nearly always the end.

    The same rounds, but what is scored anew is only what can feel a difference: rows whose deviations have moved as far as they are felt, and those within
    ``REACH`` of them. A round's files go when they have been read.
    """
    both = list(dict.fromkeys((*users, *hosts)))
    person, cohort, host = F.col("username").isNotNull(), F.coalesce(F.col("role_name"), F.lit("")) != "", F.coalesce(F.col("agent_id"), F.lit("")) != ""
    told = {"u": users, "r": users, "h": hosts}
    sums = {f"__{k}{i}": "double" for k, features in told.items() for i in range(len(features))} | {f"__v{i}": "double" for i in range(len(both))} | {"__bits": "int", "__sig": "long"}
    full = lambda df, there: df.select("payload_id", "sess", *(there.get(c, F.lit(None)).cast(t).alias(c) for c, t in sums.items()))
    now, before, old = base.withColumns({"calm_user": F.lit(True), "calm_host": F.lit(True)}), None, []
    for n in itertools.count():
        bits = person.cast("int") + F.when(cohort, 2).otherwise(0) + F.when(host, 4).otherwise(0)
        parts = [full(now, {f"__v{i}": F.col(f) for i, f in enumerate(both)} | {"__bits": bits})]
        if before is not None:  # the first round knows nobody: priors alone
            far = _far(now, kinds, states, felt)
            mine = {f"__{k}{i}": F.when(F.col("kind") == kind, F.col(f"z{i}")) for k, kind in (("u", "user"), ("r", "role"), ("h", "host")) for i in range(len(told[k]))}
            parts += [full(far, mine), full(before, {"__sig": F.col("sig")})]
        met = reduce(DataFrame.unionByName, parts).repartition("sess").groupBy("sess", "payload_id").agg(*(F.max(c).alias(c) for c in sums))
        has = lambda bit: F.col("__bits").bitwiseAND(bit) > 0
        none = F.lit(None).cast("double")

        def prior(f, priors, bounds):
            v = F.col(f"__v{both.index(f)}")
            z = F.lit(0.0) if f not in priors[0] else _z(v, F.lit(priors[0][f][0]), F.lit(priors[0][f][1]), f, priors[1])
            return F.when(v.isNotNull(), _felt(z, bounds))

        def near(column, present):
            # what was left out is not felt, what is nan is not known
            return F.when(present, F.nanvl(F.coalesce(F.col(column), F.lit(0.0)), none)) if before is not None else none

        z = {f"z_{f}": F.when(has(1), F.coalesce(F.nanvl(F.col(f"__u{i}"), none), near(f"__r{i}", has(2)), prior(f, (USER_PRIORS, FLOOR_USER), felt["user"]))) for i, f in enumerate(users)}
        z |= {f"host_z_{f}": F.when(has(4), F.coalesce(near(f"__h{i}", has(4)), prior(f, (HOST_PRIORS, FLOOR_HOST), felt["host"]))) for i, f in enumerate(hosts)}
        met = met.withColumns(z).withColumn("sig", F.xxhash64(F.lit(0), *z))
        met = met.select("payload_id", "sess", *z, "sig", F.coalesce(F.col("sig") != F.col("__sig"), F.lit(True)).alias("moved"))
        met = write(met.withColumn("moved", F.max("moved").over(Window.partitionBy("sess"))), f"met-{n}")
        scored = score(rows.join(met.where("moved").select("payload_id", *z), "payload_id"))
        risk = F.col("risk_score")
        calm = write(scored.select("payload_id", teaches_user(risk).alias("__user"), teaches_host(risk, F.col("burst"), [F.col("sure")]).alias("__host")), f"guess-{n}")
        kept = {"calm_user": F.when(F.col("__met"), F.col("__user")).otherwise(F.col("calm_user")), "calm_host": F.when(F.col("__met"), F.col("__host")).otherwise(F.col("calm_host"))}
        after = now.join(calm.withColumn("__met", F.lit(True)), "payload_id", "left")
        flipped = ~F.col("calm_user").eqNullSafe(kept["calm_user"]) | ~F.col("calm_host").eqNullSafe(kept["calm_host"])
        after = write(after.select(*base.columns, *(c.alias(name) for name, c in kept.items()), flipped.alias("flipped")), f"now-{n}")
        flips = after.where("flipped").limit(1).count()
        for name in old:
            forget(name)
        now, before, old = after, met, [f"{name}-{n}" for name in ("now", "met", "guess")]
        if n and not flips:
            return now.select("payload_id", "calm_user", "calm_host"), n + 1


def learn(rows: DataFrame, score: Callable[[DataFrame], DataFrame], users: tuple[str, ...] = USER_FEATURES, hosts: tuple[str, ...] = HOST_FEATURES, states: DataFrame | None = None, felt: dict[str, tuple[float, float]] | None = None, whole: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """(scored rows, states afterwards, rounds).

    ``rows``: payload_id, username, role_name, agent_id, ts, arrived and features. ``score`` gets them with ``z_<feature>`` (of the user) and
    ``host_z_<feature>`` and adds ``risk_score`` and the booleans ``burst`` and ``sure`` (a sign that by itself keeps a host from learning).
    ``felt``: for user and host, below which deviation the score is the same as at 0, and from which on as at this one. It spares scoring, it does not
    change the end: the last round scores all rows by what they are. Without ``whole`` scored rows have payload_id, risk_score, burst and sure alone.
    """
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/learning-{uuid.uuid4().hex[:12]}"

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def forget(name: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    number = lambda f: F.nanvl(F.col(f).try_cast("double"), F.lit(None).cast("double")).alias(f)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    both = [f for f in dict.fromkeys((*users, *hosts)) if f in rows.columns]
    users, hosts = (tuple(f for f in names if f in both) for names in (users, hosts))
    person = F.nullif(F.trim("username"), F.lit(""))
    rows = write(rows, "rows")  # made once, each round reads it
    # what lies further apart than REACH is another sitting: no row's score looks from one into the other
    order = Window.partitionBy("username", "agent_id").orderBy("__at", "payload_id")
    sat = rows.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__first", F.coalesce(F.col("__at") - F.lag("__at").over(order) > REACH, F.lit(True)))
    sat = sat.withColumn("sess", F.last(F.when(F.col("__first"), F.col("payload_id").cast("long")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    base = write(sat.select(F.col("payload_id").cast("long"), "sess", person.alias("username"), F.lower(person).alias("member"), F.when(person.isNotNull(), F.col("role_name")).alias("role_name"), "agent_id", micros("ts"), micros("arrived"), *map(number, both)), "base")
    kinds = {"user": ("username", "calm_user", users), "role": ("role_name", "calm_user", users), "host": ("agent_id", "calm_host", hosts)}
    calm, rounds = _approach(base, rows, score, users, hosts, kinds, states, felt or dict.fromkeys(("user", "host"), (-math.inf, math.inf)), write, forget)
    while True:
        folded = write(fold(base.join(calm.hint("merge"), "payload_id"), kinds, states), f"folded-{rounds}")
        met = rows
        for i, kind in enumerate(kinds):
            # equal arrays make small files: never taken for a table that a task could hold
            met = met.join(folded.where((F.col("kind") == kind) & F.col("payload_id").isNotNull()).select("payload_id", F.col("seen").alias(f"__seen_{i}")).hint("merge"), "payload_id", "left")
        told = {f"z_{f}": F.when(person.isNotNull(), deviation(f, number(f), [F.col("__seen_0"), F.col("__seen_1")], i, USER_PRIORS.get(f), FLOOR_USER)) for i, f in enumerate(users)}
        told |= {f"host_z_{f}": F.when(F.coalesce(F.col("agent_id"), F.lit("")) != "", deviation(f, number(f), [F.col("__seen_2")], i, HOST_PRIORS.get(f), FLOOR_HOST)) for i, f in enumerate(hosts)}
        scored = score(met.withColumns(told).drop(*(f"__seen_{i}" for i in range(3))))
        scored = write(scored if whole else scored.select("payload_id", "risk_score", "burst", "sure"), f"scored-{rounds}")
        risk = F.col("risk_score")
        after = write(scored.select("payload_id", teaches_user(risk).alias("calm_user"), teaches_host(risk, F.col("burst"), [F.col("sure")]).alias("calm_host")), f"calm-{rounds}")
        rounds += 1
        changed = after.exceptAll(calm.select("payload_id", "calm_user", "calm_host")).limit(1).count()
        calm = after
        if not changed:
            break
    return scored, folded.where("entity is not null").select("kind", "entity", "state"), rounds

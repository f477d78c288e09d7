"""Centroid clustering of whole-number vectors: Lloyd's rounds that touch only what changed.

Vectors are quantised to floor(``scale`` * x). Assignments are persisted, a row a block of vectors, and so are the global sums
and counts of clusters (k x (dimensions + 1) numbers). In a round a vector whose owner stayed where it was is compared with
the centroids that moved alone, since all others were already no nearer; a vector whose owner moved is compared with all.
A vector that changes its owner takes itself from one sum and adds itself to the other: the round's transfers are
added up as signed integers in the block, then by Spark over all blocks, and only they change the global sums. A round without
moved centroids compares nothing. The vectors themselves are written once, as files of the shared folder, and never again.

All arithmetic is exact: components are at most 2**24 in size (beyond it an error says so), sums are added as decimals.
Kept are vectors with exactly ``dimensions`` components, none null, NaN or infinite; others have no row in the result, nor has a null
vector. Ties go to the smaller number, empty clusters keep their centroid. First centroids are the ``k`` kept vectors whose id
hashes smallest (equal hashes: by components; rows that repeat an id may all be chosen; rows without id only after all others); of fewer vectors, all.
Repeated rows count each. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import map_arrays, materialize, new_folder, table, write_arrays

K, DIMENSIONS, SCALE, ROUNDS = 16, 64, 64, 3
#: Vectors in a block, and the largest size of a component: squares of differences of 64 of them stay far below 2**63.
BLOCK, LARGEST = 1 << 16, 1 << 24
STATE = "block long, path string, owner binary, distance binary, transfers array<struct<cluster:int,place:int,delta:long>>"


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the vectors that are kept, as whole numbers."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    fine = (F.size("x") == dimensions) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform("x", lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale)).otherwise(F.raise_error(F.lit(f"a component is larger than {LARGEST} after scaling"))).cast("int"))
    return vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(fine).select("vec_id", whole.alias("q"))


def seeds(kept: DataFrame, k: int = K) -> np.ndarray:
    """The first centroids: at most ``k`` rows reach the driver."""
    order = F.struct(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    top = kept.select(order.alias("o")).orderBy(F.col("o.h").isNull(), "o").limit(k).collect()
    return np.array([r.o.q for r in top], np.int64)


def _blocks(kept: DataFrame, folder: str, dimensions: int) -> DataFrame:
    """(block, path, owner, distance, transfers): the vectors of a block wait in a file, nobody owns them yet."""

    def task(batches):
        context = TaskContext.get()
        block, ids, parts, held = (context.partitionId() if context else 0) << 32, [], [], 0

        def flush():
            path, q = f"{folder}/{uuid.uuid4().hex}", np.concatenate(parts)
            known = np.array([i is not None for i in ids])
            width = np.int8 if not len(q) or -128 <= q.min() <= q.max() <= 127 else np.int32
            write_arrays(path, {"ids": np.array([i or 0 for i in ids], np.int64), "known": known.astype(np.uint8), "q": q.astype(width).reshape(-1)})
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "path": pa.array([path]), "owner": pa.array([np.full(len(q), -1, np.int32).tobytes()], pa.binary()), "distance": pa.array([np.zeros(len(q), np.int64).tobytes()], pa.binary()), "transfers": pa.array([[]], TRANSFERS)})

        for b in batches:
            if b.num_rows:
                ids += b.column("vec_id").to_pylist()
                parts.append(b.column("q").flatten().to_numpy().reshape(-1, dimensions))
                held += b.num_rows
                if held >= BLOCK:
                    yield flush()
                    block, ids, parts, held = block + 1, [], [], 0
        if held:
            yield flush()

    return kept.mapInArrow(task, STATE)


TRANSFERS = pa.list_(pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("delta", pa.int64())]))


def nearest(q: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids numbered ``among`` (ascending; ties: the first), and its squared distance, in whole numbers."""
    owner, distance = np.full(len(q), among[0], np.int32), np.empty(len(q), np.int64)
    for n, c in enumerate(among.tolist()):
        gap = q - centroids[c]
        d = np.einsum("ij,ij->i", gap, gap)
        if n:
            better = d < distance
            owner[better], distance[better] = c, d[better]
        else:
            distance = d
    return owner, distance


def reassign(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids numbered ``moved`` have moved; what they were before is ``owner``, ``distance``."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | np.isin(owner, moved)
    if lost.any():
        owner[lost], distance[lost] = nearest(q[lost], centroids, np.arange(len(centroids)))
    stays = np.flatnonzero(~lost)
    if len(stays) and len(moved):
        near, d = nearest(q[stays], centroids, moved)
        better = (d < distance[stays]) | ((d == distance[stays]) & (near < owner[stays]))
        owner[stays[better]], distance[stays[better]] = near[better], d[better]
    return owner, distance


def _transfers(q: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> list[dict]:
    """Signed changes of each cluster's sums; at place -1 of its count."""
    out, went = [], np.flatnonzero(old != new)
    for c in range(k):
        plus, minus = went[new[went] == c], went[old[went] == c]
        if len(plus) or len(minus):
            change = q[plus].sum(axis=0) - q[minus].sum(axis=0)
            out += [{"cluster": c, "place": j, "delta": v} for j, v in enumerate(change.tolist()) if v]
            if len(plus) != len(minus):
                out.append({"cluster": c, "place": -1, "delta": len(plus) - len(minus)})
    return out


def _vectors(path: str, dimensions: int) -> np.ndarray:
    return map_arrays(path)["q"].astype(np.int64).reshape(-1, dimensions)


def _round(state: DataFrame, centroids: np.ndarray, moved: list[int], dimensions: int) -> DataFrame:
    """The state after every vector has met the centroids that it must be compared with."""
    moved = np.array(moved, np.int64)

    def task(batches):
        for b in batches:
            for row in b.to_pylist():
                q = _vectors(row["path"], dimensions)
                old, far = np.frombuffer(row["owner"], np.int32), np.frombuffer(row["distance"], np.int64)
                new, near = reassign(q, old, far, centroids, moved)
                yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int64()), "path": pa.array([row["path"]]), "owner": pa.array([new.tobytes()], pa.binary()), "distance": pa.array([near.tobytes()], pa.binary()), "transfers": pa.array([_transfers(q, old, new, len(centroids))], TRANSFERS)})

    return state.mapInArrow(task, STATE)


def _apply(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Add the round's transfers to the global sums: at most k x (dimensions + 1) rows reach the driver."""
    each = state.select(F.explode("transfers").alias("t")).groupBy("t.cluster", "t.place").agg(F.sum(F.col("t.delta").cast("decimal(38,0)")).alias("delta"))
    for r in each.collect():
        if r.place < 0:
            counts[r.cluster] += int(r.delta)
        else:
            sums[r.cluster][r.place] += int(r.delta)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector after ``rounds`` rounds and a last assignment, and the final centroids."""
    spark, kept = vectors.sparkSession, quantised(vectors, dimensions, scale)
    centroids = seeds(kept, k)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    sums, counts, moved = [[0] * dimensions for _ in centroids], [0] * len(centroids), list(range(len(centroids)))
    state = materialize(_blocks(kept, new_folder(spark, "clustering-vectors"), dimensions), "clustering-state")
    for _ in range(rounds):
        if moved:
            state = materialize(_round(state, centroids, moved, dimensions), "clustering-state")
            _apply(state, sums, counts)
            after = np.array([[s // n for s in own] if n else c for own, n, c in zip(sums, counts, centroids.tolist())], np.int64)
            moved = [i for i in range(len(centroids)) if (after[i] != centroids[i]).any()]
            centroids = after
    if moved:
        state = materialize(_round(state, centroids, moved, dimensions), "clustering-state")

    def rows(batches):
        for b in batches:
            for row in b.to_pylist():
                held = map_arrays(row["path"])
                ids = pa.array(held["ids"], mask=held["known"] == 0)
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(np.frombuffer(row["owner"], np.int32)), "distance": pa.array(np.frombuffer(row["distance"], np.int64))})

    return state.mapInArrow(rows, schema), centroids


def op13_delta_lloyd(spark, sf_dir):
    owned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r.cluster: int(r.d) for r in owned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return owned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Full Lloyd rounds over long rows (vec_id, place, value), the rows of equal ids apart."""
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        "e AS (SELECT r, unnest(range(1, len(q) + 1)) AS place, unnest(q) AS x FROM v)",
        f"s AS (SELECT q, row_number() OVER (ORDER BY vec_id IS NULL, sha256('1:' || vec_id), q) - 1 AS c FROM v QUALIFY c < {K})",
        "c0 AS (SELECT c, unnest(range(1, len(q) + 1)) AS place, unnest(q) AS x FROM s)",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST(sum((e.x - m.x) * (e.x - m.x)) AS BIGINT) AS d FROM e JOIN c{n} m USING (place) GROUP BY r, c) GROUP BY r)")
        if n < ROUNDS:
            steps.append(f"m{n} AS (SELECT c, place, CAST(sum(x) AS HUGEINT) AS t, count(*) AS n FROM a{n} JOIN e USING (r) GROUP BY c, place)")
            steps.append(f"c{n + 1} AS (SELECT b.c, b.place, CAST(CASE WHEN t IS NULL THEN b.x WHEN t >= 0 THEN t // n ELSE -((-t + n - 1) // n) END AS BIGINT) AS x FROM c{n} b LEFT JOIN m{n} USING (c, place))")
    last = f"a{ROUNDS}"
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS digest FROM c{ROUNDS} GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256 FROM {last} JOIN v USING (r) JOIN h USING (c)"


QUERIES = {"op13_delta_lloyd": op13_delta_lloyd}
SQL = {"op13_delta_lloyd": _sql()}

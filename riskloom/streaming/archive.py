"""Cold archive of received days: chunks with a digest chain, written, read back, published, and only then is the source dropped.

A day's rows go by (time, id) into chunks of at most ``ROWS`` rows or ``BYTES`` of JSON, compressed, each with its SHA-256; the chain runs over
(number, digest, rows) of the chunks. A run writes everything under a folder of its own and reads it back; one line in the ledger then names the run as
the day's. So whatever is broken off leaves the source whole and the ledger as it was, and running again gives the same archive. Rows are
read from the ledger's runs and from the live days that it doesn't name: never twice, also while a source that is archived already still lies there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a chunk, chunks of a day at most (their digests are chained in order on the driver).
ROWS, BYTES, CHUNKS = 1000, 4 << 20, 100_000
_CHUNK = "part int, n int, records long, size long, checksum string, data binary"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _note(spark: SparkSession, root: str, line: dict) -> None:
    """A line of the ledger: a flat object in a file of its own, complete only with its last brace."""
    name = f"{root}/ledger/{line['day']}-{len(_lines(spark, root)):08}-{uuid.uuid4().hex[:8]}.json"
    fs, p = _fs(spark, name)
    out = fs.create(p, False)
    out.write(bytearray((json.dumps(line) + "\n").encode()))
    out.close()


def _lines(spark: SparkSession, root: str) -> list[dict]:
    """The ledger in order: some lines a day."""
    if not _exists(spark, f"{root}/ledger"):
        return []
    rows = spark.read.option("wholetext", True).text(f"{root}/ledger").select("value", F.input_file_name().alias("file")).collect()
    order = sorted(rows, key=lambda r: r.file.rsplit("/", 1)[1].rsplit("-", 2)[1])
    return [json.loads(r.value) for r in order if r.value.rstrip().endswith("}")]


def verified(spark: SparkSession, root: str) -> dict[str, dict]:
    """The published run of each archived day."""
    out: dict[str, dict] = {}
    for line in _lines(spark, root):
        if line["state"] == "verified":
            out[line["day"]] = line
        else:
            out.pop(line["day"], None)
    return out


def chunks(rows: DataFrame, time: str, key: str) -> DataFrame:
    """Rows in order as chunks: a task cuts its range of (time, key) by rows and bytes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held, size = None, 0, [], 2

        def end():
            plain = ("[" + ",".join(held) + "]").encode()
            return pd.DataFrame([[part, n, len(held), len(plain), hashlib.sha256(plain).hexdigest(), zlib.compress(plain)]], columns=["part", "n", "records", "size", "checksum", "data"])

        for b in batches:
            for p, line in zip(b["part"], b["line"]):
                more = len(line.encode()) + 1
                if more > BYTES:
                    raise ValueError("one row is larger than a chunk may be")
                if held and (len(held) == ROWS or size + more > BYTES or p != part):
                    yield end()
                    n, held, size = (n + 1 if p == part else 0), [], 2
                part = int(p)
                held.append(line)
                size += more
        if held:
            yield end()

    names = sorted(rows.columns)
    ordered = rows.repartitionByRange(time, key).sortWithinPartitions(time, key)
    return ordered.select(F.spark_partition_id().alias("part"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line")).mapInPandas(cut, _CHUNK)


def opened(found: DataFrame, schema: str) -> DataFrame:
    """The rows in chunks, each checked against its digest, size and count."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for records, size, checksum, data in zip(b["records"], b["size"], b["checksum"], b["data"]):
                plain = zlib.decompress(data)
                lines = json.loads(plain)
                if len(plain) != size or len(lines) != records or hashlib.sha256(plain).hexdigest() != checksum:
                    raise ValueError("a chunk differs from its digest, size or count")
                yield pd.DataFrame({"line": [json.dumps(x) for x in lines]})

    return found.select("records", "size", "checksum", "data").mapInPandas(read, "line string").select(F.from_json("line", schema).alias("r")).select("r.*")


def chain(spark: SparkSession, run: str) -> tuple[str, int, int]:
    """The digest over a run's chunks in order, their number and their rows."""
    digest, rows = hashlib.sha256(), 0
    found = spark.read.parquet(f"{run}/chunks").select("part", "n", "checksum", "records").orderBy("part", "n").limit(CHUNKS + 1).collect()
    if len(found) > CHUNKS:
        raise ValueError(f"a day of more than {CHUNKS} chunks")
    for i, c in enumerate(found):
        digest.update(json.dumps([i, c.checksum, c.records], separators=(",", ":")).encode())
        rows += c.records
    return digest.hexdigest(), len(found), rows


def archive_day(spark: SparkSession, live: str, root: str, day: str, time: str = "ts", key: str = "event_id", after: Callable[[str], None] = lambda step: None) -> bool:
    """Archive ``live``/received_day=``day``, which takes no more rows; whether there was anything to do. ``after`` is told of each step that has ended."""
    source, done = f"{live}/received_day={day}", verified(spark, root).get(day)
    if not _exists(spark, source):
        if done:
            return False
        raise ValueError(f"{day} has no rows and no archive")
    rows = spark.read.parquet(source)
    run = f"{root}/runs/{day}-{uuid.uuid4().hex[:12]}"
    _note(spark, root, {"day": day, "state": "building"}) if not done else None
    after("building")
    if not done:
        chunks(rows, time, key).write.parquet(f"{run}/chunks")
        after("chunks")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        back = opened(spark.read.parquet(f"{run}/chunks"), schema)
        digest, pieces, records = chain(spark, run)
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()
        if tuple(mark(back)) != tuple(mark(rows)) or records != rows.count():
            raise ValueError(f"{day}: what was read back differs from the source; the source stays")
        after("read back")
        totals = rows.groupBy("collector", "status").agg(F.count("*").alias("n"))
        totals.write.parquet(f"{run}/totals")
        newest = F.max_by(F.struct(key, time), F.struct(time, key)).alias("x")
        rows.groupBy("agent_id", "collector").agg(newest).select("agent_id", "collector", "x.*").write.parquet(f"{run}/latest")
        if (spark.read.parquet(f"{run}/totals").agg(F.sum("n")).first()[0] or 0) != records:
            raise ValueError(f"{day}: totals differ from the rows; the source stays")
        after("totals")
        _note(spark, root, {"day": day, "state": "verified", "run": run, "records": records, "chunks": pieces, "checksum": digest})
        after("published")
    _drop(spark, source)
    after("dropped")
    return True


def expire(spark: SparkSession, root: str, cutoff: str) -> list[str]:
    """Drop the archive of every published day before ``cutoff``: first from the ledger, then its files. The days dropped."""
    gone = sorted(d for d in verified(spark, root) if d < cutoff)
    for day in gone:
        run = verified(spark, root)[day]["run"]
        _note(spark, root, {"day": day, "state": "expired"})
        _drop(spark, run)
    return gone


def _runs(spark: SparkSession, root: str, part: str) -> list[str]:
    return [f"{line['run']}/{part}" for line in verified(spark, root).values()]


def _live(spark: SparkSession, live: str, root: str) -> DataFrame | None:
    fs, p = _fs(spark, live)
    if not fs.exists(p) or not any(f.getPath().getName().startswith("received_day=") for f in fs.listStatus(p)):
        return None
    return spark.read.parquet(live).withColumn("received_day", F.col("received_day").cast("string")).where(~F.col("received_day").isin(list(verified(spark, root))))


def rows(spark: SparkSession, live: str, root: str, schema: str) -> DataFrame:
    """Every row once: of archived days from their runs, of others from ``live``."""
    runs, out = _runs(spark, root, "chunks"), _live(spark, live, root)
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    out = None if out is None else out.select(*names)
    if runs:
        cold = opened(spark.read.parquet(*runs), schema).select(*names)
        out = cold if out is None else out.unionByName(cold)
    return spark.createDataFrame([], schema) if out is None else out


def totals(spark: SparkSession, live: str, root: str) -> DataFrame:
    """(collector, status, n) over all days: archived ones by their totals, others counted."""
    runs, out = _runs(spark, root, "totals"), _live(spark, live, root)
    out = None if out is None else out.groupBy("collector", "status").agg(F.count("*").alias("n"))
    if runs:
        cold = spark.read.parquet(*runs)
        out = cold if out is None else out.unionByName(cold)
    if out is None:
        return spark.createDataFrame([], "collector string, status string, n long")
    return out.groupBy("collector", "status").agg(F.sum("n").alias("n"))

"""Snapshots as a stream: every line ends in exactly one place, whatever is wrong with it and however late it comes.

A micro-batch tells its lines apart:

- broken ones (``body_violations``), ones ahead of the clock and ones older than the watermark are dead letters with their reason,
  before anything else sees them: no broken line moves the watermark, and no late one vanishes;
- a payload_id that came before, in this batch or an earlier one, with equal content (canonical JSON) is a repeat, counted and let go;
  with other content it is a dead letter, ``conflict``;
- the rest is accepted.

The watermark is the newest accepted collection time less ``LATENESS``; nobody's clock is part of it. A folder of files that is taken in at once (``drain``) moves it at the end. What was accepted before is a table,
``registry`` (payload_id, digest, by day), of which a batch reads the days after the watermark alone. A batch writes each of its
outputs to a folder of its number and a line to ``manifest`` last; it reads only what batches before it have written. So a batch that is broken off
anywhere and runs again replaces what it had written and decides the same.

Dead letters come back by ``replay``: released ones are put in front of the same stream again with the number of their attempts, so
there is one writer; one that has failed ``ATTEMPTS`` times stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.content import canonical_json
from riskloom.operators.ingest import body_violations

#: How late a snapshot may come to be told from one that came before, and how far ahead of the clock it may lie.
LATENESS, AHEAD = "interval 1 day", "interval 5 minutes"
ATTEMPTS = 3
COLLECTORS = "array<struct<collector:string,status:string,payload:string>>"
REGISTRY, MANIFEST = "payload_id string, digest string, day date, batch long", "newest timestamp, accepted long, repeats long, dead long, batch long"
DEAD = "body string, reason string, attempts long, batch long"


def read(spark: SparkSession, folder: str, files: int = 1000, size: int | None = 1 << 30) -> DataFrame:
    """Lines as they arrive, as (value); a micro-batch takes at most ``size`` bytes (at least a file) or ``files`` files where no size is given."""
    limit = ("maxBytesPerTrigger", size) if size else ("maxFilesPerTrigger", files)
    return spark.readStream.option(*limit).option("recursiveFileLookup", True).text(folder)


def opened(lines: DataFrame) -> DataFrame:
    """(body, attempts, released): lines as they are, or taken out of the wrapper that ``replay`` puts round them."""
    wrapped = F.from_json("value", "replayed_body string, attempts long, released string")
    again = wrapped["replayed_body"].isNotNull()
    return lines.select(F.when(again, wrapped["replayed_body"]).otherwise(F.col("value")).alias("body"), F.when(again, wrapped["attempts"]).otherwise(0).alias("attempts"), F.when(again, wrapped["released"]).alias("released"))


def examined(lines: DataFrame, clock=None) -> DataFrame:
    """Each line with payload_id, agent_id, collected_at, collectors, digest, and ``reason``: what is wrong with it by itself, null if nothing."""
    wrong, v = body_violations(F.col("body")), F.try_parse_json("body")
    at = F.try_variant_get(v, "$.collected_at", "string").try_cast("timestamp")
    rows = opened(lines).withColumns({
        "payload_id": F.try_variant_get(v, "$.payload_id", "string"), "agent_id": F.try_variant_get(v, "$.agent_id", "string"), "collected_at": at,
        "collectors": F.try_variant_get(v, "$.collectors", COLLECTORS), "wrong": wrong, "digest": F.sha2(canonical_json("body"), 256),
    })
    ahead = F.col("collected_at") > (F.current_timestamp() if clock is None else clock) + F.expr(AHEAD)
    reason = F.when(F.size("wrong") > 0, F.array_join("wrong", ",")).when(F.col("collected_at").isNull(), "collected_at").when(ahead, "future")
    return rows.withColumn("reason", reason).drop("wrong")


def _earlier(spark: SparkSession, root: str, table: str, schema: str, number: int) -> DataFrame:
    """What the batches before this one have written; an empty table at first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}") if there else spark.createDataFrame([], schema)
    return rows.where(F.col("batch") < number)


def judged(rows: DataFrame, known: DataFrame, mark) -> DataFrame:
    """``examined`` rows with a final ``reason``: a line of its own, ``late``, ``conflict``, ``repeat``, or null for the one accepted of its payload_id.

    ``known``: (payload_id, digest) accepted before; ``mark``: the watermark, null at first. Equal lines are counted (``times``) before ids meet,
    so an id that is sent over and over is one row; of a batch's different contents the earliest is taken, then the least digest.
    """
    late = F.coalesce(F.col("collected_at") < F.lit(mark).cast("timestamp"), F.lit(False)) & (F.coalesce("released", F.lit("")) != "late")
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(late, "late")))
    same = ["payload_id", "agent_id", "collected_at", "digest"]
    fine = rows.where("reason is null").groupBy(*same).agg(F.count("*").alias("times"), F.min(F.struct("body", "attempts", "collectors")).alias("one"))
    fine = fine.select(*same, "times", "one.*")
    first = Window.partitionBy("payload_id").orderBy("collected_at", "digest")
    fine = fine.withColumn("nth", F.row_number().over(first)).join(known.groupBy("payload_id").agg(F.min("digest").alias("known")), "payload_id", "left")
    verdict = F.when(F.col("known") == F.col("digest"), "repeat").when(F.col("known").isNotNull() | (F.col("nth") > 1), "conflict")
    wrong = rows.where("reason is not null").select(*same, F.lit(1).cast("long").alias("times"), "body", "attempts", "collectors", "reason")
    return fine.withColumn("reason", verdict).select(*wrong.columns).unionByName(wrong)


def take(batch: DataFrame, number: int, root: str, clock=None, since: int | None = None) -> None:
    """One micro-batch of lines into ``root``: accepted, dead, registry, manifest. ``since``: the watermark is that of the batches before this one."""
    spark = batch.sparkSession
    newest = _earlier(spark, root, "manifest", MANIFEST, number if since is None else min(number, since)).agg(F.max("newest")).first()[0]
    mark = None if newest is None else spark.range(1).select(F.lit(newest).cast("timestamp") - F.expr(LATENESS)).first()[0]
    # rows come out of every batch that is asked for here: a line read once is kept until its outputs are written
    rows = examined(batch, clock).persist()
    known = _earlier(spark, root, "registry", REGISTRY, number)
    if mark is not None and not rows.where("released = 'late'").limit(1).count():
        known = known.where(F.col("day") >= F.to_date(F.lit(mark)))
    done = judged(rows, known, mark).persist()
    good = done.where("reason is null")
    into = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/batch={number}")
    into(done.where("reason is not null and reason != 'repeat'").select("body", "reason", (F.col("attempts") + 1).alias("attempts")), "dead")
    good.select("payload_id", "agent_id", "collected_at", "collectors", F.to_date("collected_at").alias("received_day")).write.mode("overwrite").partitionBy("received_day").parquet(f"{root}/accepted/batch={number}")
    into(good.select("payload_id", "digest", F.to_date("collected_at").alias("day")), "registry")
    into(done.agg(F.max(F.when(F.col("reason").isNull(), F.col("collected_at"))).alias("newest"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.sum(F.when(F.col("reason") == "repeat", F.col("times")).when(F.col("reason").isNull(), F.col("times") - 1).otherwise(0)).alias("repeats"), F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "repeat")).alias("dead")), "manifest")
    done.unpersist()
    rows.unpersist()


def ingest(stream: DataFrame, root: str, checkpoint: str, clock=None, **trigger):
    """Start the query: lines of ``stream`` into the tables under ``root``."""
    return stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, root, clock)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def drain(stream: DataFrame, root: str, checkpoint: str, clock=None) -> None:
    """Take in all that lies there now, in as many micro-batches as its size asks for, and end.

    What lies there together has come together: files have no order of time, so all of it is held against the watermark from before the run, and where
    a batch ends makes no line late. The run's first batch is noted in ``draining`` until its end: one that is broken off goes on by the same watermark.
    """
    spark = stream.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/draining")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        last = _earlier(spark, root, "manifest", MANIFEST, 1 << 62).agg(F.max("batch")).first()[0]
        spark.range(1).select(F.lit(0 if last is None else last + 1).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{root}/draining")
    since = spark.read.schema("batch long").parquet(f"{root}/draining").first()[0]
    start = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, root, clock, since)).option("checkpointLocation", checkpoint)
    start.trigger(availableNow=True).start().awaitTermination()
    files.delete(path, True)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """accepted, dead, registry or manifest of the batches that have ended: those with a line in the manifest."""
    ended = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").select("batch")
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").join(F.broadcast(ended), "batch", "left_semi")


def replay(spark: SparkSession, root: str, folder: str, checkpoint: str, reasons: list[str], attempts: int = ATTEMPTS, **trigger):
    """Start the query that puts dead letters of these reasons (beginnings of them) back into ``folder``, each until it has failed ``attempts`` times.

    ``late`` ones are released: they are taken this time. A batch that has written its file is not written again.
    """

    def put(batch: DataFrame, number: int) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/replay-{number}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return
        again = batch.where(F.lit(False) if not reasons else F.col("reason").rlike("^(" + "|".join(reasons) + ")")).where(F.col("attempts") < attempts)
        wrapped = F.to_json(F.struct(F.col("body").alias("replayed_body"), "attempts", F.when(F.col("reason") == "late", "late").alias("released")))
        again.select(wrapped.alias("value")).write.mode("overwrite").text(f"{folder}/replay-{number}")

    stream = spark.readStream.schema(DEAD).parquet(f"{root}/dead")
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def on_time(arrivals: DataFrame, entity: str, arrived: str, seen: str) -> DataFrame:
    """``arrivals`` with ``on_time``: whether what was seen lies after all that the entity had shown when it arrived."""
    from pyspark.sql import Window

    before = F.max(seen).over(Window.partitionBy(entity).orderBy(arrived).rowsBetween(Window.unboundedPreceding, -1))
    return arrivals.withColumn("on_time", before.isNull() | (F.col(seen) > before))


def archive(rows: DataFrame, day, number: str, columns: list[str], size: int = 1000) -> DataFrame:
    """(day, rows, chunks, chain): a day's rows in chunks by ranges of ``number``, each with a SHA-256, and the chain over them.

    A chunk has at most ``size`` rows, and a day's chain one digest a chunk.
    """
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    chunks = rows.groupBy(day.alias("day"), F.floor(F.col(number) / size).alias("chunk")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
    days = chunks.groupBy("day").agg(F.sum("n").alias("rows"), F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("chunk", "digest"))).alias("all"))
    link = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.col("all")[0]["digest"], lambda chain, c: F.sha2(F.concat(chain, c["digest"]), 256))
    return days.select("day", "rows", "chunks", link.alias("chain"))

"""Queries that run as streams: the same results as their batch forms, micro-batch by micro-batch.

A table becomes a stream of ``CHUNKS`` chunks in order of arrival, one a micro-batch; each query works through them and returns
the table that it wrote.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.catalog import query
from tidemark.functions.time import Tumbling
from tidemark.operators.sinks import first_writes
from tidemark.queries import _DUPLICATES, _E, _WM, DAY, HOUR, WRITES_WITH_TTL, duplicates, events
from tidemark.sources.backends import FileBackend, LogBackend, open_topic, register_backend
from tidemark.sources.commit_log import CommitLog
from tidemark.storage import children, new_path
from tidemark.streaming.late import LateSplitter
from tidemark.streaming.monitor import Monitor
from tidemark.streaming.sinks import IdempotentTable
from tidemark.streaming.stateful import keyed_fold
from tidemark.streaming.stream import Stream

CHUNKS = 3
#: Rows of a file of a chunk, about; a task writes each.
CHUNK_FILE_ROWS = 500_000


def as_stream(spark: SparkSession, rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows as files in order, a chunk read in each micro-batch.

    A micro-batch takes a number of files, the oldest first, so all chunks have as many: those that the largest one fills.
    """
    path = new_path(spark, name)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // CHUNKS + 1
    chunk = F.floor((F.col(order) - (low or 0)) / step)
    files = max((r["count"] for r in rows.groupBy(chunk.alias("chunk")).count().collect()), default=0) // CHUNK_FILE_ROWS + 1
    for i in range(CHUNKS):
        part = rows.where(chunk == i)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
        # Tasks without rows make no files; empty ones stand in, so that the next chunk's don't.
        while sum(x.endswith(".parquet") for x in children(spark, path)) < files * (i + 1):
            part.limit(0).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def arrived(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "user_id", "ms", "arr", "cents", (F.col("arr") * 100_000_000 + F.col("event_id")).alias("seq"))


def _late(spark: SparkSession, d: str) -> LateSplitter:
    out = LateSplitter("ms", ["arr", "event_id"], Tumbling(HOUR), HOUR, new_path(spark, "late-out"))
    out.start(as_stream(spark, arrived(spark, d), "arr", "late-in"), new_path(spark, "late-checkpoint")).awaitTermination()
    return out


@query("late_stream", _WM.format(delay=HOUR) + f" SELECT event_id, ms // {HOUR} * {HOUR} AS start_ms, watermark_ms FROM m WHERE ms // {HOUR} * {HOUR} + {HOUR} < watermark_ms")
def late_stream(spark, d):
    return _late(spark, d).late(spark).select("event_id", "start_ms", "watermark_ms")


@query("on_time_stream", _WM.format(delay=HOUR) + f" SELECT ms // {HOUR} * {HOUR} AS start_ms, count(*) AS n FROM m WHERE ms // {HOUR} * {HOUR} + {HOUR} >= watermark_ms GROUP BY 1")
def on_time_stream(spark, d):
    return _late(spark, d).on_time(spark).groupBy("start_ms").agg(F.count("*").alias("n"))


@query("dedup_stream", f"SELECT event_id, 'tidemark:sink:stream:' || event_id AS token, min(seq) AS seq FROM ({_DUPLICATES}) GROUP BY 1, 2")
def dedup_stream(spark, d):
    path = new_path(spark, "dedup-out")
    source = as_stream(spark, duplicates(spark, d), "seq", "dedup-in")
    writer = source.writeStream.foreachBatch(IdempotentTable("stream", path, order="seq")).option("checkpointLocation", new_path(spark, "dedup-checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "token", "seq")


@query("dedup_ttl_stream", WRITES_WITH_TTL)
def dedup_ttl_stream(spark, d):
    """Tokens are forgotten a day after their last write."""
    path = new_path(spark, "dedup-ttl-out")
    rows = events(spark, d).select("event_id", "user_id", "event_type", "ms", F.concat_ws("-", "user_id", "event_type").alias("key"))
    writer = as_stream(spark, rows, "event_id", "dedup-ttl-in").writeStream.foreachBatch(IdempotentTable("ttl", path, "key", "event_id", DAY, "ms", merge_every=2))
    writer.option("checkpointLocation", new_path(spark, "dedup-ttl-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("user_id", "event_type", "ms")


@query("stateful_stream", f"WITH e AS ({_E}) SELECT user_id, list_reduce(list_prepend(7::BIGINT, list(cents ORDER BY arr, event_id)), lambda s, x: (s * 31 + x) % 1000003) AS state, count(*) AS n FROM e GROUP BY 1")
def stateful_stream(spark, d):
    path = new_path(spark, "state-out")
    source = as_stream(spark, arrived(spark, d).select("user_id", "arr", "seq", "cents"), "arr", "state-in").drop("arr")
    folded = keyed_fold(source, "user_id", "seq", "state long, n long", (7, 0), lambda s, r: ((s[0] * 31 + r.cents) % 1000003, s[1] + 1))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    folded.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", new_path(spark, "state-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(path).groupBy("user_id").agg(F.max_by(F.struct("state", "n"), "batch_id").alias("s"))
    return last.select("user_id", "s.state", "s.n")


@query("window_stream", f"SELECT ms // {HOUR} * {HOUR} AS start_ms, count(*) AS n FROM ({_E}) GROUP BY 1")
def window_stream(spark, d):
    """Spark's own windows and watermark: rows in order, so nothing is late; windows are given as the watermark passes them, the open ones read from the state."""
    path, checkpoint = new_path(spark, "window-out"), new_path(spark, "window-checkpoint")
    source = as_stream(spark, events(spark, d).select("event_id", F.timestamp_millis("ms").alias("at")), "event_id", "window-in")
    counts = source.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n"))
    rows = counts.select(F.unix_millis("window.start").alias("start_ms"), "n")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    still = spark.read.format("statestore").load(checkpoint).select(F.unix_millis("key.window.start").alias("start_ms"), F.col("value.count").alias("n"))
    return first_writes(spark.read.schema("start_ms long, n long").parquet(path).unionByName(still).withColumn("k", F.col("start_ms")), ["k"], "start_ms").select("start_ms", "n")


@query("retry_stream", "SELECT event_id, 'ValueError: poison ' || event_id AS _error, 'events' AS _original_stream FROM events WHERE event_id % 7 = 0")
def retry_stream(spark, d):
    """A handler of records that always fails for some and fails twice for others: only the former are dead letters, and the stream goes on to its end."""
    path = new_path(spark, "retry")
    topic = LogBackend(spark, "events", "readers", events(spark, d).select("event_id", "user_id").schema, path=path)
    for part in range(CHUNKS):
        topic.append(events(spark, d).where(F.col("event_id") % CHUNKS == part).select("event_id", "user_id").coalesce(2))
    stream = Stream(spark, topic, f"{path}/checkpoints", delay=lambda attempt: 0.0)

    @stream.subscribe(each=True, maxFilesPerTrigger="2")
    def handle(record, attempt):
        if record["event_id"] % 7 == 0:
            raise ValueError(f"poison {record['event_id']}")
        if record["event_id"] % 5 == 0 and attempt < 3:
            raise ValueError("not yet")

    stream.run()
    return LogBackend(spark, "events-dlq", "readers", path=path).read().select("event_id", "_error", "_original_stream")


_TOPIC = "SELECT event_id, user_id, event_type FROM events"


def _rows(spark, d):
    return events(spark, d).select("event_id", "user_id", "event_type")


@query("file_topic", _TOPIC)
def file_topic(spark, d):
    """Events appended to an NDJSON topic in two parts, one of them twice under one key."""
    topic = FileBackend(spark, "events", "g", _rows(spark, d).schema, path=new_path(spark, "file"))
    topic.append(_rows(spark, d).where("event_id % 2 = 0"))
    for _ in range(2):
        topic.append_once(_rows(spark, d).where("event_id % 2 = 1"), "odd")
    return topic.read()


@query("plugin_topic", f"SELECT event_type, count(*) AS n FROM ({_TOPIC}) GROUP BY 1")
def plugin_topic(spark, d):
    """A backend that a plugin registers, opened by its name, with another topic of the same place."""
    register_backend("registered", LogBackend)
    main = open_topic(spark, "events", "g", "registered", path=new_path(spark, "plugin"))
    other = main.with_topic("others")
    main.append(_rows(spark, d).where("user_id % 2 = 0"))
    other.append(_rows(spark, d).where("user_id % 2 = 1"))
    return main.read().unionByName(other.read()).groupBy("event_type").agg(F.count("*").alias("n"))


@query("dlq_purge", "SELECT count(*) FILTER (event_type = 'error') AS before, 0::BIGINT AS after FROM events")
def dlq_purge(spark, d):
    path = new_path(spark, "purge")
    _rows(spark, d).where("event_type = 'error'").write.parquet(path)
    before = spark.read.parquet(path).count()
    cli.dlq_purge(spark, path)
    return spark.read.parquet(path).agg(F.count("*").alias("after")).withColumn("before", F.lit(before))


@query("log_rotation", "SELECT user_id % 4 AS partition, count(*) AS n, true AS rotated FROM events GROUP BY 1")
def log_rotation(spark, d):
    """Segments of at most 50 rows, each a range of offsets of its own."""
    log = CommitLog(spark, new_path(spark, "segments", listed=False), segment_rows=50)
    log.append(_rows(spark, d), F.col("user_id"), ["event_id"], F.col("user_id") % 4)
    files = log.read().groupBy("partition", F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    sound = (F.max("n") <= 50) & (F.sum(F.col("high") - F.col("low") + 1) == F.sum("n")) & (F.count("*") > 1)
    return files.groupBy("partition").agg(F.sum("n").alias("n"), sound.alias("rotated"))


@query("group_resume", f"SELECT event_id, event_id % 2 AS run FROM ({_TOPIC})")
def group_resume(spark, d):
    """A group that starts again goes on behind what it has handled; each event is handled once."""
    path = new_path(spark, "resume")
    topic, out = LogBackend(spark, "events", "g", _rows(spark, d).schema, path=path), LogBackend(spark, "handled", "g", path=path)
    for run in range(2):
        topic.append(_rows(spark, d).where(F.col("event_id") % 2 == run))
        stream = Stream(spark, topic, f"{path}/checkpoints")

        @stream.subscribe()
        def keep(batch, batch_id):
            out.append_once(batch.select("event_id", F.lit(run).cast("long").alias("run")), f"run-{run}-{batch_id}")  # noqa: B023

        stream.run()
    return out.read()


@query("monitor_rows", "SELECT count(*) AS rows, 0::BIGINT AS dropped_late FROM events")
def monitor_rows(spark, d):
    """Rows that the queries of a stream report."""
    path, monitor = new_path(spark, "monitor"), Monitor().install(spark)
    query = as_stream(spark, _rows(spark, d), "event_id", "monitor-in").writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.ck").trigger(availableNow=True).start()
    query.awaitTermination()
    for _ in range(100):
        if any(not running for running in monitor.running.values()):
            break
        time.sleep(0.1)
    spark.streams.removeListener(monitor)
    return monitor.table(spark).where(F.col("batch_id") >= 0).agg(F.sum("rows").alias("rows"), F.sum("dropped_late").alias("dropped_late"))

"""Handlers per topic, each run as a streaming query with its own checkpoint.

A handler gets a micro-batch: ``(batch)``, ``(batch, batch_id)`` or ``(batch, batch_id, context)``; with ``each=True`` it gets one
record as a dict, ``(record)`` or ``(record, attempt)``, and runs on the executors. Rows that fail the schema's checks go to the
topic's dead letters before it is called.

What fails is tried again after a growing delay. Attempts are counted in tables beside the checkpoint, so the count survives a
crash: of a handler of records, those that failed are written after each attempt, and only they are tried again; of a handler of
batches, the batch is. What has failed more than ``max_retries`` times goes to the dead letters with its error, and the stream
goes on. Dead letters are appended under their batch's name, so a batch that runs again adds none twice. A group's position is its
queries' checkpoints, so a restart goes on where it stopped.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.keys import traceparent
from tidemark.functions.time import Assigner
from tidemark.logs import set_up_logging
from tidemark.operators.delivery import MAX_RETRIES, dead_letters
from tidemark.operators.validation import GENERIC, validate_split
from tidemark.settings import Settings
from tidemark.sources.backends import Backend, open_topic
from tidemark.storage import children, shared_dir, write_once
from tidemark.streaming.late import LateSplitter
from tidemark.workers import importable

Handler = Callable[..., None]


@dataclass
class Context:
    """What a handler may use besides its batch."""

    topic: str
    group: str
    emit: Callable[..., None]


@dataclass
class _Subscription:
    topic: str
    handler: Handler
    checks: dict[str, Column]
    each: bool
    options: dict[str, str]


def delay_seconds(attempt: int) -> float:
    """1, 2, 4, ... seconds, a minute at most."""
    return min(60.0, 2.0 ** (attempt - 1))


@dataclass
class Stream:
    spark: SparkSession
    backend: Backend
    checkpoints: str
    max_retries: int = MAX_RETRIES
    delay: Callable[[int], float] = delay_seconds
    subscriptions: list[_Subscription] = field(default_factory=list)
    queries: dict[str, StreamingQuery] = field(default_factory=dict)

    def subscribe(self, topic: str | None = None, checks: dict[str, Column] | None = None, each: bool = False, **options: str) -> Callable[[Handler], Handler]:
        """Register a handler of a topic's micro-batches, or of each of its records; ``options`` are those of the source, such as a limit per trigger."""

        def add(handler: Handler) -> Handler:
            self.subscriptions.append(_Subscription(topic or self.backend.topic, handler, checks or {}, each, options))
            return handler

        return add

    def window(self, windows: Assigner, ms: str, order: list[str], path: str, topic: str | None = None, delay_ms: int = 0) -> LateSplitter:
        """Split a topic by windows and watermark into ``<path>/on_time`` and ``<path>/late``."""
        splitter = LateSplitter(ms, order, windows, delay_ms, path)
        self.subscribe(topic)(lambda batch, batch_id: splitter(batch, batch_id))
        return splitter

    @classmethod
    def configured(cls, spark: SparkSession, topic: str, group: str, schema: T.StructType | None = None, settings: Settings | None = None) -> Stream:
        """A stream over the backend, checkpoints and retries of the settings."""
        settings = settings or Settings.load()
        set_up_logging(settings.log_format)
        backend = open_topic(spark, topic, group, None if settings == Settings.load() else settings.backend, schema, **settings.options(settings.backend))
        return cls(spark, backend, settings.checkpoints or f"{shared_dir(spark)}/checkpoints", settings.max_retries)

    def emit(self, rows: DataFrame, topic: str | None = None, trace: bool = False) -> None:
        """Append rows to a topic; a missing event type becomes GenericEvent. With ``trace`` they carry a trace context, which goes on from the one that they have."""
        if trace:
            rows = rows.withColumn("traceparent", traceparent(F.col("traceparent") if "traceparent" in rows.columns else None))
        kind = F.coalesce("event_type", F.lit(GENERIC)) if "event_type" in rows.columns else F.lit(GENERIC)
        target = self.backend if topic is None else self.backend.with_topic(topic)
        target.append(rows.withColumn("event_type", kind))

    def _dead(self, sub: _Subscription, failed: DataFrame, key: str) -> None:
        """Move rows with an ``__error`` to the topic's dead letters, once for a key."""
        at = F.col("offset") if "offset" in failed.columns else F.lit(None)
        moved = dead_letters(failed, F.col("__error"), F.lit(sub.topic), at, F.current_timestamp()).drop("__error")
        self.backend.with_topic(sub.topic).dead_letters().append_once(moved, key)

    def _run(self, sub: _Subscription, name: str) -> Callable[[DataFrame, int], None]:
        arity = len(inspect.signature(sub.handler).parameters)
        context = Context(sub.topic, self.backend.group, self.emit)
        key = name.replace("/", "-")

        def run(batch: DataFrame, batch_id: int) -> None:
            tries = f"{self.checkpoints}/{name}-attempts/batch_id={batch_id}"
            held = batch.persist()
            try:
                if sub.checks:
                    batch, bad = validate_split(batch, sub.checks)
                    if not bad.isEmpty():
                        self._dead(sub, bad.withColumnRenamed("_error", "__error"), f"{key}-{batch_id}-invalid")
                if sub.each:
                    self._records(sub, batch, tries, f"{key}-{batch_id}", arity)
                else:
                    self._batch(sub, batch, tries, f"{key}-{batch_id}", lambda: sub.handler(*(batch, batch_id, context)[: max(1, min(arity, 3))]))
            finally:
                held.unpersist()

        return run

    def _batch(self, sub: _Subscription, batch: DataFrame, tries: str, key: str, call: Callable[[], None]) -> None:
        while True:
            done = len(children(self.spark, tries))
            if done > self.max_retries:
                last = self.spark.read.schema("__error string").parquet(f"{tries}/attempt={done}").first()
                return self._dead(sub, batch.withColumn("__error", F.lit(last["__error"] if last else "cut short")), key)
            try:
                return call()
            except Exception as error:
                text = f"{type(error).__name__}: {error}"[:2000]
                write_once(self.spark.createDataFrame([(text,)], "__error string").coalesce(1), f"{tries}/attempt={done + 1}")
                if done < self.max_retries:
                    time.sleep(self.delay(done + 1))

    def _records(self, sub: _Subscription, batch: DataFrame, tries: str, key: str, arity: int) -> None:
        """Attempts go on from the last one that was written whole; one that was cut short runs again."""
        schema = T.StructType([*batch.schema.fields, T.StructField("__error", T.StringType())])
        done = 0
        while f"attempt={done + 1}" in children(self.spark, tries) and "_SUCCESS" in children(self.spark, f"{tries}/attempt={done + 1}"):
            done += 1
        failed = batch if not done else self.spark.read.schema(schema).parquet(f"{tries}/attempt={done}")
        while done <= self.max_retries and (not done or not failed.isEmpty()):
            if done:
                time.sleep(self.delay(done))
            done += 1
            write_once(failures(failed.select(*batch.columns), sub.handler, done, arity), f"{tries}/attempt={done}")
            failed = self.spark.read.schema(schema).parquet(f"{tries}/attempt={done}")
        if not failed.isEmpty():
            self._dead(sub, failed, key)

    def start(self, available_now: bool = False) -> list[StreamingQuery]:
        for i, sub in enumerate(self.subscriptions):
            name = f"{self.backend.group}/{sub.topic}/{i}"
            source = self.backend.with_topic(sub.topic)
            rows = source.read_stream(**sub.options)
            writer = rows.writeStream.foreachBatch(self._run(sub, name)).option("checkpointLocation", f"{self.checkpoints}/{name}")
            self.queries[name] = (writer.trigger(availableNow=True) if available_now else writer).start()
        return list(self.queries.values())

    def run(self) -> None:
        """Work through all that is there, then return."""
        for query in self.start(available_now=True):
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries.values():
            query.stop()

    #: A paused stream is a stopped one: it resumes from its checkpoints.
    pause = stop

    def resume(self) -> list[StreamingQuery]:
        return self.start()

    def health(self) -> dict[str, object]:
        failed = {n: str(q.exception()) for n, q in self.queries.items() if q.exception() is not None}
        return {"status": "error" if failed else "ok", "active": sum(q.isActive for q in self.queries.values()), "failed": failed}

    def __enter__(self) -> Stream:
        return self

    def __exit__(self, *_: object) -> None:
        self.stop()


def failures(rows: DataFrame, handler: Callable[..., object], attempt: int, arity: int) -> DataFrame:
    """Run a handler on every record, on the executors; gives the records that it failed for, with the error as ``__error``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("__error", T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema)
        for part in parts:
            failed = []
            for record in part.to_pylist():
                try:
                    handler(*(dict(record), attempt)[: max(1, min(arity, 2))])
                except Exception as error:
                    failed.append({**record, "__error": f"{type(error).__name__}: {error}"[:2000]})
            yield pa.RecordBatch.from_pylist(failed, schema=kind)

    importable(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def union(streams: list[DataFrame]) -> DataFrame:
    """Fan-in of several topics."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)

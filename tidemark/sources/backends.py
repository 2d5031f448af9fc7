"""Backends: one interface for topics on NDJSON files, in the commit log, in memory and in Kafka, with a registry for more.

A backend gives a batch or streaming DataFrame of a topic and appends one; offsets, acknowledgements and retries are tables
and checkpoints (``operators.delivery``), the same for all of them.
"""

from __future__ import annotations

import logging
import os
import tempfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.delivery import CLAIM
from tidemark.settings import Settings
from tidemark.sources.redis_stream import PAGE, SCHEMA, Client, RedisSource
from tidemark.storage import one_machine, shared_dir, write_once
from tidemark.workers import importable

log = logging.getLogger(__name__)

ENTRY_POINTS = "tidemark.plugins"
DLQ, LATE = "-dlq", "-late"


class Backend(ABC):
    def __init__(self, spark: SparkSession, topic: str, group: str, schema: T.StructType | None = None, **options: str):
        self.spark, self.topic, self.group, self.schema, self.options = spark, topic, group, schema, options

    def with_topic(self, topic: str) -> Backend:
        """The same place and group, another topic."""
        return type(self)(self.spark, topic, self.group, self.schema, **self.options)

    @abstractmethod
    def read(self) -> DataFrame: ...

    @abstractmethod
    def read_stream(self, **options: object) -> DataFrame: ...

    @abstractmethod
    def append(self, rows: DataFrame) -> None: ...

    def append_once(self, rows: DataFrame, key: str) -> None:
        """Append under a key; file and log topics do nothing for a key that they have, others add the rows again and leave it to readers to tell them by id."""
        self.append(rows)

    def dead_letters(self) -> Backend:
        return self.with_topic(self.topic + DLQ)

    def late(self) -> Backend:
        return self.with_topic(self.topic + LATE)

    def ping(self) -> bool:
        self.read().limit(1).count()
        return True


class FileBackend(Backend):
    """NDJSON below ``path``, a folder per topic; lines that aren't JSON are dropped."""

    @property
    def location(self) -> str:
        return f"{self.options['path'].rstrip('/')}/{self.topic}"

    def _typed(self) -> T.StructType:
        if self.schema is None:
            raise ValueError("a file topic needs a schema")
        return self.schema

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._typed()).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(self.location)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], self._typed())

    def read_stream(self, **options: object) -> DataFrame:
        return self.spark.readStream.options(**options).schema(self._typed()).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(self.location)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").json(self.location)

    def append_once(self, rows: DataFrame, key: str) -> None:
        write_once(rows, f"{self.location}/{key}", "json")


class LogBackend(Backend):
    """Parquet below ``path``, a folder per topic."""

    @property
    def location(self) -> str:
        return f"{self.options['path'].rstrip('/')}/{self.topic}"

    def read(self) -> DataFrame:
        reader = self.spark.read.option("recursiveFileLookup", "true")
        return reader.parquet(self.location) if self.schema is None else reader.schema(self.schema).parquet(self.location)

    def read_stream(self, **options: object) -> DataFrame:
        return self.spark.readStream.options(**options).option("recursiveFileLookup", "true").schema(self.schema or self.read().schema).parquet(self.location)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.location)

    def append_once(self, rows: DataFrame, key: str) -> None:
        write_once(rows, f"{self.location}/{key}")


class MemoryBackend(Backend):
    """Rows kept by the driver's process, for tests and examples; topics are shared within a process. Where all tasks run in that
    process, appends are written to a temporary folder as well, for a stream to read; on a cluster there is none."""

    topics: dict[str, list[DataFrame]] = {}
    keys: set[tuple[str, str]] = set()
    folder: str | None = None

    @property
    def location(self) -> str:
        if MemoryBackend.folder is None:
            MemoryBackend.folder = tempfile.mkdtemp(prefix="tidemark-memory-")
        return f"{MemoryBackend.folder}/{self.topic}"

    def read(self) -> DataFrame:
        parts = self.topics.get(self.topic, [])
        if not parts:
            return self.spark.createDataFrame([], self.schema or T.StructType([]))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def read_stream(self, **options: object) -> DataFrame:
        if not one_machine(self.spark):
            raise ValueError("a memory topic lives in the driver's process; use another backend on a cluster")
        schema = self.schema or self.read().schema
        if not schema.fields:
            raise ValueError(f"the topic {self.topic!r} has neither a schema nor a row to take it from")
        os.makedirs(self.location, exist_ok=True)
        return self.spark.readStream.options(**options).schema(schema).parquet(f"file://{self.location}")

    def append(self, rows: DataFrame) -> None:
        held = self.spark.createDataFrame(rows.collect(), rows.schema)
        if one_machine(self.spark):
            held.coalesce(1).write.mode("append").parquet(f"file://{self.location}")
        self.topics.setdefault(self.topic, []).append(held)

    def append_once(self, rows: DataFrame, key: str) -> None:
        if (self.topic, key) not in self.keys:
            self.append(rows)
            self.keys.add((self.topic, key))


class KafkaBackend(Backend):
    """A Kafka topic; values are JSON, keys the event ids. Needs Spark's Kafka package on the class path."""

    def _options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.options["servers"], "subscribe": self.topic, "startingOffsets": "earliest", "groupIdPrefix": self.group}

    def _decoded(self, raw: DataFrame) -> DataFrame:
        text = F.col("value").cast("string")
        value = F.from_json(text, self.schema) if self.schema else F.try_parse_json(text)
        return raw.select("topic", "partition", "offset", F.concat_ws("-", "partition", "offset").alias("msg_id"), "timestamp", value.alias("data")).where(F.col("data").isNotNull())

    def read(self) -> DataFrame:
        return self._decoded(self.spark.read.format("kafka").options(**self._options()).load())

    def read_stream(self, **options: object) -> DataFrame:
        return self._decoded(self.spark.readStream.format("kafka").options(**{**options, **self._options()}).load())

    def append(self, rows: DataFrame) -> None:
        key = F.col("event_id").cast("string") if "event_id" in rows.columns else F.lit(None).cast("string")
        rows.select(key.alias("key"), F.to_json(F.struct(*rows.columns)).alias("value")).write.format("kafka").options(**{"kafka.bootstrap.servers": self.options["servers"], "topic": self.topic}).save()


class RedisBackend(Backend):
    """A Redis or Valkey stream; options as in ``sources.redis_stream``. Fields come as a map of strings."""

    def _source(self) -> dict[str, str]:
        self.spark.dataSource.register(RedisSource)
        importable(self.spark)
        return {**self.options, "stream": self.topic}

    def read(self) -> DataFrame:
        return self.spark.read.format(RedisSource.name()).options(**self._source()).load()

    def read_stream(self, **options: object) -> DataFrame:
        return self.spark.readStream.format(RedisSource.name()).options(**{**options, **self._source()}).load()

    def append(self, rows: DataFrame) -> None:
        nested = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        text = {c: F.to_json(c) if c in nested else F.col(f"`{c}`").cast("string") for c in rows.columns}
        fields = F.create_map(*[x for c, v in text.items() for x in (F.lit(c), v)])
        rows.select(F.lit(None).cast("string").alias("msg_id"), fields.alias("fields")).write.format(RedisSource.name()).options(**self._source()).mode("append").save()


    # Consumer groups: a batch of bounded size is read, handled and acknowledged by one consumer.

    def ensure_group(self, start: str = "0") -> None:
        with Client(self.options) as client:
            client.ensure_group(self.topic, self.group, start)

    def _frame(self, entries: list) -> DataFrame:
        return self.spark.createDataFrame(entries, SCHEMA)

    def read_group(self, consumer: str, count: int | None = None) -> DataFrame:
        """The group's next entries, ``count`` (the setting's batch size) at most."""
        with Client(self.options) as client:
            return self._frame(client.read_group(self.topic, self.group, consumer, count or Settings.load().batch_size))

    def ack(self, handled: DataFrame) -> int:
        """Acknowledge the rows' ``msg_id``, from the executors."""
        options, topic, group = dict(self.options), self.topic, self.group

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                with Client(options) as client:
                    yield pa.RecordBatch.from_arrays([pa.array([client.ack(topic, group, part.column(0).to_pylist()) if part.num_rows else 0], pa.int64())], names=["n"])

        importable(self.spark)
        return handled.select("msg_id").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    def pending(self, min_idle_ms: int = 0, count: int = PAGE) -> DataFrame:
        with Client(self.options) as client:
            return self.spark.createDataFrame(client.pending(self.topic, self.group, min_idle_ms, count), "msg_id string, consumer string, idle_ms long, deliveries long")

    def claim_stuck(self, consumer: str, min_idle_ms: int | None = None, count: int = CLAIM) -> DataFrame:
        """Entries that consumers have left for the idle time (the setting's), taken over: what a crashed consumer had."""
        idle = Settings.load().min_idle_ms if min_idle_ms is None else min_idle_ms
        with Client(self.options) as client:
            ids = [x[0] for x in client.pending(self.topic, self.group, idle, count)]
            return self._frame(client.claim(self.topic, self.group, consumer, idle, ids))


_BACKENDS: dict[str, type[Backend]] = {"file": FileBackend, "log": LogBackend, "memory": MemoryBackend, "kafka": KafkaBackend, "redis": RedisBackend}
_loaded = False


def register_backend(name: str, backend: type[Backend]) -> None:
    _BACKENDS[name] = backend


_STATE_STORES: dict[str, str] = {"memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def register_state_store(name: str, provider: str) -> None:
    """A state store by the class of Spark's provider interface that makes it."""
    _STATE_STORES[name] = provider


def use_state_store(spark: SparkSession, name: str) -> None:
    """Keep the state of streams that start from now on in a registered store."""
    load_plugins()
    if name not in _STATE_STORES:
        raise ValueError(f"no state store named {name!r}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORES[name])


class Registry:
    """What a plugin's function gets: called, it registers a backend; it also takes state stores."""

    def __call__(self, name: str, backend: type[Backend]) -> None:
        register_backend(name, backend)

    backend = __call__

    def state_store(self, name: str, provider: str) -> None:
        register_state_store(name, provider)


def get_backend(name: str) -> type[Backend] | None:
    load_plugins()
    return _BACKENDS.get(name)


def load_plugins(found: Callable[..., list] = entry_points) -> None:
    """Run the functions of the entry-point group once; one that fails is logged and skipped."""
    global _loaded
    if _loaded:
        return
    _loaded = True
    for entry in found(group=ENTRY_POINTS):
        try:
            entry.load()(Registry())
        except Exception:
            log.exception("plugin %s failed to load", entry.name)


def open_topic(spark: SparkSession, topic: str | None, group: str | None, format: str | None = None, schema: T.StructType | None = None, **options: str) -> Backend:
    """A backend by name, or by the settings of the environment. One from the environment that is unknown or can't be made gives
    way to memory with a warning; one named by the caller is an error."""
    if not topic or not group:
        raise ValueError("a topic and a group are needed")
    settings = Settings.load()
    name = format or settings.backend
    try:
        kind = get_backend(name)
        if kind is None:
            raise ValueError(f"no backend named {name!r}")
        given = {**settings.options(name), **options}
        if issubclass(kind, FileBackend | LogBackend) and "path" not in given:
            given["path"] = f"{shared_dir(spark)}/topics"
        return kind(spark, topic, group, schema, **given)
    except Exception:
        if format or name == "memory":
            raise
        log.warning("backend %s can't be used, memory is", name, exc_info=True)
        return MemoryBackend(spark, topic, group, schema, **options)

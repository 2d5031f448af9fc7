"""Idempotent writes: which rows a sink lets through."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import sink_token
from tidemark.workers import importable

TTL_SECONDS = 86_400


def first_writes(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first event of each key: what a sink that never forgets writes. Combined before the shuffle, so a key that comes very often is a row per task."""
    rest = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), seq).alias("__first"))
    return first.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__first.`{c}`").alias(c) for c in events.columns])


def with_token(events: DataFrame, sink: str, event_id: Column) -> DataFrame:
    return events.withColumn("token", sink_token(sink, event_id))


def new_tokens(events: DataFrame, written: DataFrame) -> DataFrame:
    """Events whose token isn't in the table of those written; the anti-join that each micro-batch does."""
    return events.join(written.select("token").distinct(), "token", "left_anti")


def writes_with_ttl(events: DataFrame, keys: list[str], ms: str, ttl_ms: int, written: DataFrame | None = None) -> DataFrame:
    """(keys, ms) of the writes by a sink that forgets a key ``ttl_ms`` after its last write: greedy, in order of time. ``written``
    has the last write of keys from before, as (keys, ms).

    Which events are written depends on all before them, so a key's distinct times go through one task, a list at a time.
    """
    names, at, kinds = list(keys), events.select(*keys, F.col(ms).cast("long").alias(ms)).distinct(), events.select(*keys).schema
    at = at.withColumn("__old", F.lit(False))
    if written is not None:
        at = at.unionByName(written.select(*keys, F.col(ms).cast("long").alias(ms), F.lit(True).alias("__old")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            rows, keep = list(zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)), []
            for i, (now, t, old) in enumerate(zip(rows, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                if old or now != key or t > last + ttl_ms:
                    key, last = now, t
                    if not old:
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    importable(events.sparkSession)
    # A write from before comes first, whatever the times of late events.
    ordered = at.repartition(*names).sortWithinPartitions(*names, F.col("__old").desc(), ms)
    return ordered.mapInArrow(run, T.StructType([*kinds.fields, T.StructField(ms, T.LongType())]))

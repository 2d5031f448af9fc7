"""Keys, partitions, tokens, ids and delays as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_KEY = "default_key"


def partition_of(key: Column, partitions: int) -> Column:
    """Partition of a key: crc32 of its text, modulo the number of partitions; the same in every process."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(partitions)).cast("int")


def key_or_default(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(DEFAULT_KEY))


def state_key(topic: Column, key: Column, start_ms: Column, end_ms: Column) -> Column:
    """Name of a window's state; the topic is part of it, so windows of two topics can't meet."""
    seconds = lambda ms: (ms / F.lit(1000.0)).cast("string")
    return F.concat_ws(":", topic, key_or_default(key), seconds(start_ms), seconds(end_ms))


def session_state_key(topic: Column, key: Column) -> Column:
    return F.concat_ws(":", topic, key_or_default(key), F.lit("session"), F.lit("active"))


def sink_token(sink: str, event_id: Column) -> Column:
    return F.concat(F.lit(f"tidemark:sink:{sink}:"), event_id.cast("string"))


def parse_message_id(msg_id: Column) -> Column:
    """A "<high>-<low>" or plain number id as a struct that orders by number, not by text."""
    parts = F.split(msg_id, "-")
    return F.struct(F.get(parts, F.lit(0)).cast("long").alias("hi"), F.coalesce(F.get(parts, F.lit(1)).cast("long"), F.lit(0)).alias("lo"))


def traceparent(parent: Column | None = None) -> Column:
    """A trace context in W3C form: the parent's trace with a new span, or a new trace where there is none."""
    span, fresh = F.substring(F.md5(F.uuid().cast("binary")), 1, 16), F.md5(F.uuid().cast("binary"))
    trace = fresh if parent is None else F.coalesce(F.when(parent.rlike("^00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$"), F.get(F.split(parent, "-"), F.lit(1))), fresh)
    return F.concat(F.lit("00-"), trace, F.lit("-"), span, F.lit("-01"))


def backoff_seconds(attempts: Column) -> Column:
    """Delay before the next try, without jitter: 1, 2, 4, ... seconds."""
    return F.pow(F.lit(2.0), attempts - 1)


def truthy(value: Column, kind: str) -> Column:
    """A predicate's value as a boolean: null, zero and empty text are false."""
    if kind == "string":
        return F.coalesce(F.length(value) > 0, F.lit(False))
    return F.coalesce(value.cast("boolean"), F.lit(False))

"""Keyed state as tables: last write wins, expiry, running values and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.keys import partition_of


def latest(puts: DataFrame, keys: list[str], seq: str, deleted: str | None = None) -> DataFrame:
    """The last put of each key by ``seq``; keys whose last put is a tombstone are gone."""
    rest = [c for c in puts.columns if c not in keys]
    top = puts.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
    return top.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else top


def alive(state: DataFrame, put_ms: str, ttl_seconds: str, now_ms: int | Column) -> DataFrame:
    """State that hasn't expired at an instant; a null time to live never does."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return state.where(F.col(ttl_seconds).isNull() | (now <= F.col(put_ms) + F.col(ttl_seconds) * 1000))


def put_batch(state: DataFrame, entries: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return latest(state.unionByName(entries), keys, seq)


def get(wanted: DataFrame, state: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """The value of each wanted key, or the default where there is none."""
    found = wanted.join(state.select(*keys, F.col(value).alias("__value"), F.lit(True).alias("__there")), keys, "left")
    return found.withColumn(value, F.when(F.col("__there"), F.col("__value")).otherwise(default)).drop("__value", "__there")


def lookup(wanted: DataFrame, state: DataFrame, key: str, value: str, partitions: int, leases: DataFrame | None = None) -> DataFrame:
    """(key, partition, node_id, value, found) of each wanted key: where its state lives, by the leases of partitions, and what it is.

    A key without state is found = false; a partition that nobody leads has no node.
    """
    out = wanted.select(key).withColumn("partition", partition_of(F.col(key), partitions))
    out = out.join(state.select(key, F.col(value).alias("value"), F.lit(True).alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if leases is None:
        return out.withColumn("node_id", F.lit(None).cast("string"))
    return out.join(leases.select("partition", "node_id"), "partition", "left")


def running(df: DataFrame, keys: list[str], order: list[str], name: str, aggregate: Column) -> DataFrame:
    """A per-key aggregate after each row, in order."""
    return df.withColumn(name, aggregate.over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def checkpoints(commits: DataFrame, seq: str) -> DataFrame:
    """The last committed id of each stream and group, by order of commits."""
    return commits.groupBy("stream", "group").agg(F.max_by("msg_id", seq).alias("msg_id"))


def after_checkpoint(messages: DataFrame, checkpoint: DataFrame, keys: list[str], seq: str, at: str) -> DataFrame:
    """Messages beyond the checkpoint of their keys, compared by number; without a checkpoint, all."""
    marks = checkpoint.select(*keys, F.col(at).alias("__at"))
    return messages.join(marks, keys, "left").where(F.col("__at").isNull() | (F.col(seq) > F.col("__at"))).drop("__at")

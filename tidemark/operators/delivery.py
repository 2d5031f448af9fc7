"""Delivery by consumer groups as queries: reads, commits, retries, dead letters, replay, claims and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import backoff_seconds

MAX_RETRIES = 3
MIN_IDLE_MS = 60_000
CLAIM = 50


def read_batch(messages: DataFrame, after: int | Column, count: int, seq: str = "seq") -> DataFrame:
    """The next ``count`` messages beyond a position."""
    return messages.where(F.col(seq) > after).orderBy(seq).limit(count)


def commits(acked: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Position to resume from: one beyond the largest acknowledged offset."""
    return acked.groupBy(*keys).agg((F.max(offset) + 1).alias("committed"))


def retry_outcomes(attempts: DataFrame, count: str = "attempts", max_retries: int = MAX_RETRIES) -> DataFrame:
    """``outcome``: dead_letter once a message has failed more than ``max_retries`` times, else retry; with its backoff."""
    return attempts.withColumn("outcome", F.when(F.col(count) > max_retries, "dead_letter").otherwise("retry")).withColumn("backoff_s", backoff_seconds(F.col(count)))


def attempt_counts(failures: DataFrame, acked: DataFrame, key: str = "msg_id", seq: str = "seq") -> DataFrame:
    """Failures per message since it was last acknowledged, by order of ``seq``: an acknowledgement clears the counter."""
    cleared = acked.groupBy(key).agg(F.max(seq).alias("__cleared"))
    open_ = failures.join(cleared, key, "left").where(F.col("__cleared").isNull() | (F.col(seq) > F.col("__cleared")))
    return open_.groupBy(key).agg(F.count("*").alias("attempts"))


def dead_letters(failed: DataFrame, error: Column, stream: Column, msg_id: Column, moved_at: Column) -> DataFrame:
    """Messages with the fields that a dead letter carries."""
    return failed.select("*", error.cast("string").alias("_error"), stream.cast("string").alias("_original_stream"), msg_id.cast("string").alias("_original_msg_id"), moved_at.cast("string").alias("_moved_timestamp"))


def strip_metadata(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def replay(dlq: DataFrame, seq: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(messages to append again, what stays): the oldest dead letters without their metadata."""
    oldest = dlq.orderBy(seq).limit(limit)
    return strip_metadata(oldest), dlq.join(oldest.select(seq), seq, "left_anti")


def claim_stuck(pending: DataFrame, now_ms: int, delivered_ms: str = "delivered_ms", seq: str = "seq", min_idle_ms: int = MIN_IDLE_MS, count: int = CLAIM) -> DataFrame:
    """The oldest messages that were delivered and not acknowledged for the idle time."""
    return pending.where(F.lit(now_ms) - F.col(delivered_ms) >= min_idle_ms).orderBy(seq).limit(count)


def lag(ends: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """``lag`` per key from its end; a partition that was never committed counts whole."""
    return ends.join(committed, keys, "left").withColumn("lag", F.greatest(F.lit(0), F.col("end") - F.coalesce("committed", F.lit(0))))


def reset_offsets(offsets: DataFrame, group: str, to: int | str, ends: DataFrame | None = None) -> DataFrame:
    """Offsets with one group moved to a number, to "0" (all history) or to "$" (the end)."""
    mine = F.col("group") == group
    if to == "$":
        if ends is None:
            raise ValueError("the ends of the partitions are needed to move to the end")
        moved = offsets.join(ends.select("topic", "partition", "end"), ["topic", "partition"], "left")
        return moved.withColumn("committed", F.when(mine, F.coalesce("end", "committed")).otherwise(F.col("committed"))).drop("end")
    return offsets.withColumn("committed", F.when(mine, F.lit(int(to))).otherwise(F.col("committed")))

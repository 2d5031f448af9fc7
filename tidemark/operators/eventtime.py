"""Windows, per-event watermarks, late rows and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.time import Assigner
from tidemark.plans.prefix import running_max


def assign_windows(df: DataFrame, ms: Column, windows: Assigner) -> DataFrame:
    """A row per window of each event, with start_ms and end_ms; an event in a gap has none."""
    return df.withColumn("__w", F.explode(windows.windows(ms))).withColumn("start_ms", F.col("__w.start_ms")).withColumn("end_ms", F.col("__w.end_ms")).drop("__w")


def with_watermark(df: DataFrame, ms: str, order: list[str], delay_ms: int) -> DataFrame:
    """``watermark_ms`` after each event: the largest event time so far, in arrival order and over all keys, less the delay."""
    return running_max(df, F.col(ms), order, "watermark_ms").withColumn("watermark_ms", F.col("watermark_ms") - F.lit(delay_ms))


def split_late(df: DataFrame, ms: str, order: list[str], windows: Assigner, delay_ms: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows per event and window. A window's copy is late if the window ended before the watermark; other
    windows of the event may be on time. Without a delay nothing is late."""
    if delay_ms == 0:
        rows = assign_windows(df, F.col(ms), windows)
        return rows, rows.where(F.lit(False))
    rows = assign_windows(with_watermark(df, ms, order, delay_ms), F.col(ms), windows)
    late = F.col("end_ms") < F.col("watermark_ms")
    return rows.where(~late), rows.where(late)


def _numbered(df: DataFrame, keys: list[str], at: str, order: list[str], gap: int) -> DataFrame:
    by_key = W.partitionBy(*keys).orderBy(*order)
    since = F.col(at) - F.lag(at).over(by_key)
    df = df.withColumn("__new", F.coalesce((since > gap).cast("int"), F.lit(1)))
    return df.withColumn("session_id", F.sum("__new").over(by_key.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def sessions(df: DataFrame, keys: list[str], at: str, gap: int, aggregates: list[Column], mode: str = "event", order: list[str] | None = None) -> DataFrame:
    """Sessions per key, in the unit of ``at`` and ``gap``; an event that comes ``gap`` after the last still belongs to it.

    ``event`` orders by event time. ``arrival`` goes by ``order``: an event joins the session of the one that arrived before
    it unless it is more than the gap later (an older one always joins, and moves the session's last time back).
    """
    if mode not in ("event", "arrival"):
        raise ValueError(f"unknown session mode {mode!r}")
    if mode == "arrival" and not order:
        raise ValueError("arrival mode needs an order")
    by = [at, *(order or [])] if mode == "event" else list(order or [])
    numbered = _numbered(df, keys, at, by, gap)
    return numbered.groupBy(*keys, "session_id").agg(*aggregates)


def active_sessions(sessions_by_arrival: DataFrame, keys: list[str]) -> DataFrame:
    """The session of each key that is open: the last in arrival order."""
    rest = [c for c in sessions_by_arrival.columns if c not in keys]
    top = sessions_by_arrival.groupBy(*keys).agg(F.max_by(F.struct(*rest), "session_id").alias("s"))
    return top.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])

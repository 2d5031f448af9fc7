"""Windows by Spark's own watermark: state is evicted as it passes, at the price of late rows being dropped unseen.

For late rows as an output, and for watermarks that move with every event, use ``streaming.late``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import Assigner, Session, Sliding, Tumbling


def window_column(at: str, windows: Assigner) -> Column:
    """Spark's window expression for an assigner; a slide above the size has none."""
    ms = lambda n: f"{n} milliseconds"
    if isinstance(windows, Tumbling):
        return F.window(at, ms(windows.size_ms))
    if isinstance(windows, Sliding):
        if windows.slide_ms > windows.size_ms:
            raise ValueError("Spark's windows can't leave gaps; use operators.eventtime.assign_windows")
        return F.window(at, ms(windows.size_ms), ms(windows.slide_ms))
    if isinstance(windows, Session):
        return F.session_window(at, ms(windows.gap_ms))
    raise TypeError(f"unknown windows {windows!r}")


def windowed(rows: DataFrame, at: str, keys: list[str], windows: Assigner, delay_ms: int, *aggregates: Column) -> DataFrame:
    """Aggregates per key and window of a stream (or of a batch, which has no watermark), with bounds in ms."""
    out = rows.withWatermark(at, f"{delay_ms} milliseconds") if rows.isStreaming else rows
    out = out.groupBy(*keys, window_column(at, windows).alias("__w")).agg(*aggregates)
    names = [c for c in out.columns if c not in (*keys, "__w")]
    return out.select(*keys, F.unix_millis("__w.start").alias("start_ms"), F.unix_millis("__w.end").alias("end_ms"), *names)


def distinct_within(stream: DataFrame, keys: list[str], at: str, delay_ms: int) -> DataFrame:
    """The first row of each key; repeats are known for as long as the watermark's delay, and their state goes after it."""
    return stream.withWatermark(at, f"{delay_ms} milliseconds").dropDuplicatesWithinWatermark(keys)


def joined_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, windows: Tumbling | Sliding, delay_ms: int) -> DataFrame:
    """Pairs of rows of two streams per key and shared window; the watermark bounds what is buffered."""
    side = lambda df, name: df.withWatermark(at, f"{delay_ms} milliseconds").select(*keys, window_column(at, windows).alias("window"), F.struct(*df.columns).alias(name))
    return side(left, "left").join(side(right, "right"), [*keys, "window"])

"""Joins of two streams per key and window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import Assigner
from tidemark.operators.eventtime import assign_windows


def windowed_join(left: DataFrame, right: DataFrame, keys: list[str], left_ms: str, right_ms: str, windows: Assigner, merge: Callable[[Column, Column], Column] | None = None, name: str = "merged") -> DataFrame:
    """(keys, start_ms, end_ms, left, right): a row per pair and window that both are in, so sliding windows give a pair once
    for each window they share, and sessions, whose windows start at the event, only equal times. With ``merge``, a function of the two rows as columns, a
    pair is what it gives, as ``name``; a pair for which that is null is dropped."""
    on = [*keys, "start_ms", "end_ms"]
    side = lambda df, ms, name: assign_windows(df, F.col(ms), windows).select(*on, F.struct(*df.columns).alias(name))
    pairs = side(left, left_ms, "left").join(side(right, right_ms, "right"), on)
    if merge is None:
        return pairs
    return pairs.select(*on, merge(F.col("left"), F.col("right")).alias(name)).where(F.col(name).isNotNull())

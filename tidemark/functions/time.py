"""Event time as whole numbers, and the windows that contain a time.

A window is a struct (start_ms, end_ms) of epoch milliseconds, start inclusive and end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, read as UTC whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def epoch_millis(ts: Column) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(1000)).cast("long")


def seconds_to_millis(seconds: Column) -> Column:
    """Epoch seconds to milliseconds, truncated."""
    return (seconds.cast("double") * 1000).cast("long")


def event_millis(ts: Column | None, fallback: Column | None = None) -> Column:
    """Event time in ms; a missing one falls back to processing time."""
    now = F.unix_millis(F.current_timestamp()) if fallback is None else fallback
    return now if ts is None else F.coalesce(epoch_millis(ts), now)


def _window(start: Column, size: int) -> Column:
    return F.struct(start.cast("long").alias("start_ms"), (start + F.lit(size)).cast("long").alias("end_ms"))


@dataclass(frozen=True)
class Tumbling:
    """Windows of ``size_ms``, aligned to the epoch; every time is in one."""

    size_ms: int

    def __post_init__(self) -> None:
        _positive(self.size_ms)

    def windows(self, ms: Column) -> Column:
        return F.array(_window(ms - F.pmod(ms, F.lit(self.size_ms)), self.size_ms))


@dataclass(frozen=True)
class Sliding:
    """Windows of ``size_ms`` that start each ``slide_ms``, newest first; a slide above the size leaves gaps without a window."""

    size_ms: int
    slide_ms: int

    def __post_init__(self) -> None:
        _positive(self.size_ms, self.slide_ms)

    def windows(self, ms: Column) -> Column:
        last = ms - F.pmod(ms, F.lit(self.slide_ms))
        starts = F.transform(F.sequence(F.lit(0), F.lit((self.size_ms - 1) // self.slide_ms)), lambda i: last - i * self.slide_ms)
        return F.transform(F.filter(starts, lambda s: s + self.size_ms > ms), lambda s: _window(s, self.size_ms))


@dataclass(frozen=True)
class Session:
    """Provisional session of one event: [time, time + gap). Sessions proper are made by ``operators.sessions``."""

    gap_ms: int

    def __post_init__(self) -> None:
        _positive(self.gap_ms)

    def windows(self, ms: Column) -> Column:
        return F.array(_window(ms, self.gap_ms))


Assigner = Tumbling | Sliding | Session


def _positive(*sizes: int) -> None:
    if any(x <= 0 for x in sizes):
        raise ValueError("window sizes must be positive")

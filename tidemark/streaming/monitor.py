"""What running queries report: rows, lag and status, kept as rows that the metric queries take."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "at_ms long, query string, batch_id long, rows long, rows_per_second double, dropped_late long, state_rows long, status int"


class Monitor(StreamingQueryListener):
    """Keeps the last ``keep`` reports of all queries of a session."""

    def __init__(self, keep: int = 10_000):
        self.reports: deque[tuple] = deque(maxlen=keep)
        self.running: dict[str, int] = {}

    def install(self, spark: SparkSession) -> Monitor:
        spark.streams.addListener(self)
        return self

    def onQueryStarted(self, event) -> None:
        self.running[str(event.id)] = 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators
        self.reports.append((int(time.time() * 1000), str(p.name or p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0), sum(s.numRowsDroppedByWatermark for s in states), sum(s.numRowsTotal for s in states), 1))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running[str(event.id)] = 0
        self.reports.append((int(time.time() * 1000), str(event.id), -1, 0, 0.0, 0, 0, 0))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.reports), SCHEMA)

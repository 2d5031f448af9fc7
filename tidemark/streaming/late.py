"""Exact per-event watermarks on a stream, with late rows as a second output.

Spark's own watermark moves once a micro-batch and drops late rows. Here each micro-batch takes the largest event time of all
batches before it, runs the exact batch transform within itself, and writes rows on time and late rows to two tables. All
outputs and the carried time are written to the batch's own folder, overwriting it, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.time import Assigner
from tidemark.operators.eventtime import assign_windows
from tidemark.plans.prefix import running_max


class LateSplitter:
    def __init__(self, ms: str, order: list[str], windows: Assigner, delay_ms: int, path: str):
        self.ms, self.order, self.windows, self.delay_ms, self.path = ms, order, windows, delay_ms, path.rstrip("/")

    def _carried(self, spark, batch_id: int) -> int | None:
        if batch_id == 0:
            return None
        return spark.read.parquet(f"{self.path}/carry/batch_id={batch_id - 1}").agg(F.max("max_ms")).first()[0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self._carried(spark, batch_id)
        rows = running_max(batch, F.col(self.ms), self.order, "__max")
        seen = F.greatest(F.col("__max"), F.lit(before).cast("long"))
        rows = assign_windows(rows.withColumn("watermark_ms", seen - F.lit(self.delay_ms)).drop("__max"), F.col(self.ms), self.windows)
        late = (F.col("end_ms") < F.col("watermark_ms")) if self.delay_ms else F.lit(False)
        rows.where(~late).write.mode("overwrite").parquet(f"{self.path}/on_time/batch_id={batch_id}")
        rows.where(late).write.mode("overwrite").parquet(f"{self.path}/late/batch_id={batch_id}")
        top = batch.agg(F.max(self.ms).alias("max_ms")).select(F.greatest("max_ms", F.lit(before).cast("long")).alias("max_ms"))
        top.write.mode("overwrite").parquet(f"{self.path}/carry/batch_id={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def on_time(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/on_time").drop("batch_id")

    def late(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/late").drop("batch_id")

"""The commit log: an append-only table of records with dense offsets per partition, as Parquet partitioned by ``partition``.

A scan from an offset prunes partitions by directory and row groups by the offset's statistics, so nothing below it is decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.keys import partition_of
from tidemark.plans.prefix import dense_numbers
from tidemark.storage import SMALL_FILES, children, drop_tables, exists, materialize

PARTITIONS = 4
#: Rows of a file, the log's segment, at most.
SEGMENT_ROWS = 1_000_000


def offsets(records: DataFrame, partition: Column, order: list[str], start: DataFrame | None = None) -> DataFrame:
    """Records with ``partition`` and the next dense ``offset`` of it, after the high watermarks in ``start``."""
    numbered = dense_numbers(records.withColumn("partition", partition), ["partition"], order, "offset")
    if start is None:
        return numbered
    return numbered.join(F.broadcast(start), "partition", "left").withColumn("offset", F.col("offset") + F.coalesce("high_watermark", F.lit(0))).drop("high_watermark")


def high_watermark(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg((F.max("offset") + 1).alias("high_watermark"))


def scan(log: DataFrame, partition: int, offset: int = 0) -> DataFrame:
    return log.where((F.col("partition") == partition) & (F.col("offset") >= offset))


def head(log: DataFrame, partition: int, limit: int = 10) -> DataFrame:
    return scan(log, partition).orderBy("offset").limit(limit)


def tail(log: DataFrame, limit: int = 10) -> DataFrame:
    """The last ``limit`` records of every partition."""
    ends = F.broadcast(high_watermark(log))
    return log.join(ends, "partition").where(F.col("offset") >= F.greatest(F.lit(0), F.col("high_watermark") - limit)).drop("high_watermark")


def retained(log: DataFrame, segment: Column, written_ms: str, cutoff_ms: int | Column) -> DataFrame:
    """The log without segments that were last written before the cutoff; the newest segment of a partition always stays."""
    cutoff = F.lit(cutoff_ms) if isinstance(cutoff_ms, int) else cutoff_ms
    marked = log.withColumn("__segment", segment)
    last = marked.groupBy("partition", "__segment").agg(F.max(written_ms).alias("__written"))
    active = F.max("__segment").over(W.partitionBy("partition"))
    keep = last.withColumn("__active", active).where((F.col("__segment") == F.col("__active")) | (F.col("__written") >= cutoff)).select("partition", "__segment")
    return marked.join(keep, ["partition", "__segment"], "left_semi").drop("__segment")


def recovered(log: DataFrame, sound: Column) -> DataFrame:
    """Of each partition, the records before its first one that isn't sound (by length or checksum)."""
    bad = log.groupBy("partition").agg(F.min(F.when(~F.coalesce(sound, F.lit(False)), F.col("offset"))).alias("__bad"))
    return log.join(F.broadcast(bad), "partition").where(F.col("__bad").isNull() | (F.col("offset") < F.col("__bad"))).drop("__bad")


def catch_up(leader: DataFrame, follower: DataFrame, limit: int = 100) -> DataFrame:
    """What a follower pulls: of each partition the next ``limit`` records beyond its own high watermark. Offsets are dense, so this is a range, not a sort."""
    ends = F.broadcast(high_watermark(follower))
    at = F.coalesce("high_watermark", F.lit(0))
    return leader.join(ends, "partition", "left").where((F.col("offset") >= at) & (F.col("offset") < at + limit)).drop("high_watermark")


class CommitLog:
    """A log in a directory, with the high watermarks of its partitions in small tables beside it.

    An append leaves a mark until its watermarks are written; where an append was cut short, the next one takes them from the log.
    Appends come from one writer at a time, the leader.
    """

    def __init__(self, spark: SparkSession, path: str, partitions: int = PARTITIONS, segment_rows: int = SEGMENT_ROWS):
        self.spark, self.path, self.partitions, self.segment_rows = spark, path, partitions, segment_rows

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    @property
    def _marks(self) -> str:
        return f"{self.path.rstrip('/')}.watermarks"

    def high_watermarks(self) -> DataFrame:
        """(partition, high_watermark) without reading the log, unless an append was cut short."""
        names = children(self.spark, self._marks)
        whole = [int(n.partition("=")[2]) for n in names if n.startswith("version=") and exists(self.spark, f"{self._marks}/{n}/_SUCCESS")]
        if "appending" in names or not whole:
            return high_watermark(self.read()) if self.exists() else self.spark.createDataFrame([], "partition int, high_watermark long")
        return self.spark.read.parquet(f"{self._marks}/version={max(whole)}")

    def append(self, records: DataFrame, key: Column, order: list[str], partition: Column | None = None) -> None:
        """Append records to the partition of their key, or to the one given."""
        start = materialize(self.high_watermarks(), "watermarks")
        rows = offsets(records, partition_of(key, self.partitions) if partition is None else partition.cast("int"), order, start)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self._marks}/appending")
        # Ranges of (partition, offset), so that as many tasks write as there are, and a file holds a range of offsets.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(n, "partition", "offset").sortWithinPartitions("partition", "offset")
        ranged.write.mode("append").options(**SMALL_FILES).option("maxRecordsPerFile", self.segment_rows).partitionBy("partition").parquet(self.path)
        ends = start.unionByName(high_watermark(rows)).groupBy("partition").agg(F.max("high_watermark").alias("high_watermark"))
        old = [n for n in children(self.spark, self._marks) if n.startswith("version=")]
        version = 1 + max((int(n.partition("=")[2]) for n in old), default=0)
        ends.coalesce(1).write.mode("overwrite").parquet(f"{self._marks}/version={version}")
        drop_tables(self.spark, [f"{self._marks}/{n}" for n in ("appending", *old)])

    def read_stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.read().schema).parquet(self.path)

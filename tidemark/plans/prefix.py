"""Running reductions over one total order, without a window that puts all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.storage import materialize

_PART, _LOCAL, _BEFORE = "__part", "__local", "__before"


def running_max(df: DataFrame, value: Column, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` so far in ``order``, the row's own included.

    The maximum is associative, so rows are dealt to ranges of the order and written once (sampling twice could deal them
    otherwise); each range is scanned by itself, and the largest value of all earlier ranges is added from a table that
    has one row per range, small enough to broadcast whatever the input.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.withColumn(_LOCAL, value).repartitionByRange(n, *order).withColumn(_PART, F.spark_partition_id()), "ranges")
    tops = ranged.groupBy(_PART).agg(F.max(_LOCAL).alias(_BEFORE))
    before = tops.select(_PART, F.max(_BEFORE).over(W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)).alias(_BEFORE))
    local = F.max(_LOCAL).over(W.partitionBy(_PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.join(F.broadcast(before), _PART).withColumn(name, F.greatest(local, _BEFORE)).drop(_PART, _LOCAL, _BEFORE)


def dense_numbers(df: DataFrame, keys: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each key in ``order``, however many rows a key has.

    Rows are dealt to ranges of (keys, order); a range numbers its own rows, and a table with a row per range and key in it
    says where it goes on from.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *keys, *order).withColumn(_PART, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(_PART, *keys).agg(F.count("*").alias("__n"))
    before = counts.select(_PART, *keys, (F.sum("__n").over(W.partitionBy(*keys).orderBy(_PART)) - F.col("__n")).alias(_BEFORE))
    local = F.row_number().over(W.partitionBy(_PART, *keys).orderBy(*order)) - 1
    return ranged.withColumn(_LOCAL, local).join(before, [_PART, *keys]).withColumn(name, (F.col(_LOCAL) + F.col(_BEFORE)).cast("long")).drop(_PART, _LOCAL, _BEFORE)

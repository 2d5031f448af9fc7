"""Counters, latency histograms, rates and alerts over tables of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of latency buckets, in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
LAG_ALERT = 1000
ERROR_ALERT = 0.05


def processed(outcomes: DataFrame) -> DataFrame:
    """Messages by stream and status; one that is dead-lettered counts as an error too."""
    both = F.when(F.col("status") == "dead_letter", F.array(F.lit("error"), F.lit("dead_letter"))).otherwise(F.array("status"))
    return outcomes.withColumn("status", F.explode(both)).groupBy("stream", "status").agg(F.count("*").alias("total"))


def histogram(outcomes: DataFrame, seconds: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts of successes per bucket, the last without bound."""
    counts = [F.struct(F.lit(str(b)).alias("le"), F.count(F.when(F.col(seconds) <= b, 1)).alias("n")) for b in buckets]
    rows = outcomes.where(F.col("status") == "success").groupBy("stream").agg(F.array(*counts, F.struct(F.lit("+Inf").alias("le"), F.count("*").alias("n"))).alias("b"))
    return rows.select("stream", F.explode("b").alias("b")).select("stream", "b.le", "b.n")


def quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """A quantile of each histogram by linear interpolation within its bucket; beyond the last bound, that bound."""
    rows = buckets.withColumn("__le", F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").try_cast("double")))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__le", "n"))).alias("b"), (F.max("n") * q).alias("rank"))
    at = F.filter("b", lambda x: x["n"] >= F.col("rank"))[0]
    below = F.coalesce(F.element_at(F.filter("b", lambda x: x["n"] < F.col("rank")), -1), F.struct(F.lit(0.0).alias("__le"), F.lit(0).cast("long").alias("n")))
    inside = below["__le"] + (at["__le"] - below["__le"]) * (F.col("rank") - below["n"]) / (at["n"] - below["n"])
    return rows.select(*keys, F.when(at["__le"] == float("inf"), below["__le"]).otherwise(inside).alias("value"))


def rates(outcomes: DataFrame, ms: Column, step_ms: int) -> DataFrame:
    """Messages per second by stream, status and interval."""
    at = (ms - F.pmod(ms, F.lit(step_ms))).alias("at_ms")
    return outcomes.groupBy("stream", "status", at).agg((F.count("*") * F.lit(1000.0 / step_ms)).alias("per_second"))


def error_ratio(outcomes: DataFrame, ms: Column, step_ms: int, limit: float = ERROR_ALERT) -> DataFrame:
    """Share of errors by stream and interval, and whether it is beyond the alert's limit."""
    at = (ms - F.pmod(ms, F.lit(step_ms))).alias("at_ms")
    rows = outcomes.groupBy("stream", at).agg(F.count(F.when(F.col("status") != "success", 1)).alias("errors"), F.count("*").alias("total"))
    return rows.withColumn("firing", F.col("errors") > F.col("total") * F.lit(limit))


def lag_alert(lags: DataFrame, limit: int = LAG_ALERT) -> DataFrame:
    return lags.withColumn("firing", F.col("lag") > limit)


def worker_alert(workers: DataFrame) -> DataFrame:
    """Workers that report neither running nor paused by choice."""
    return workers.withColumn("firing", F.col("status") == 0)

"""Every query of the engine with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_millis

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its oracle where SQL can express it."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    for module in ("queries", "stream_queries"):
        import_module(f"tidemark.{module}")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    for module in ("queries", "stream_queries"):
        import_module(f"tidemark.{module}")
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "window_tumbling_sum",
    """SELECT user_id, epoch_us(ts) // 3600000000 * 3600000 AS window_start_ms, round(sum(value), 4) AS total, count(*) AS n
       FROM events GROUP BY ALL""",
)
def window_tumbling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = epoch_millis(F.col("ts"))
    return e.groupBy("user_id", (ms - F.pmod(ms, F.lit(3600000))).alias("window_start_ms")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))

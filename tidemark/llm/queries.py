"""The queries of this package, by name; ``__spark_entry__`` adds them where the package exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .common import keep_only, tables

Query = Callable[[SparkSession, str], DataFrame]

MODULES: dict[str, str] = {
    "op1_warc_revisits": "warc",
    "op2_quality_rules": "quality_rules",
    "op3_pairwise_quality": "pairwise_quality",
    "op4_contextual_pii": "pii",
    "op5_license_containment": "licenses",
    "op6_simhash_components": "simhash",
    "op7_best_fit_packing": "packing",
    "op8_source_mixing": "mixing",
    "op9_gif_media": "gif",
    "op10_byte_cnn_language": "byte_cnn",
}


def tidy(query: Query) -> Query:
    """The query, dropping the tables that it has written and its result doesn't read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tables() as written:
            return keep_only(query(spark, sf_dir), written)

    return run


def queries() -> dict[str, Query]:
    return {name: tidy(import_module(f"tidemark.llm.{module}").query) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tidemark.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}

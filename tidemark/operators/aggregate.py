"""Aggregation per key and window, and folds in arrival order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import Assigner
from tidemark.operators.eventtime import assign_windows
from tidemark.workers import importable


def window_aggregate(df: DataFrame, keys: list[str], ms: Column, windows: Assigner, *aggregates: Column) -> DataFrame:
    """Built-in aggregates per key and window: partial before the shuffle, final after it."""
    return assign_windows(df, ms, windows).groupBy(*keys, "start_ms", "end_ms").agg(*aggregates)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], initial: Column, merge: Callable[[Column, Column], Column], name: str = "state") -> DataFrame:
    """Fold each key's rows in order: ``state = merge(state, row)``, a row being a struct of ``values``.

    Holds one key's rows as an array in a task; for folds that a key's size forbids this way, use a stateful stream.
    """
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*values).alias("__v")))).alias("__rows"))
    return rows.select(*keys, F.aggregate("__rows", initial, lambda s, r: merge(s, r["__v"])).alias(name))


def python_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Any], tuple], initial: tuple, schema: str) -> DataFrame:
    """The fold for what no Column expresses: ``state = fold(state, row)`` over each key's rows in order, in Python. Gives (keys, ``schema``).

    A key's rows are held by one worker, as with ``ordered_fold``.
    """
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    names = [*keys, *(x.split()[0] for x in schema.split(","))]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        now = initial
        for row in rows.sort_values(order, kind="stable").itertuples(index=False):
            now = fold(now, row)
        return pd.DataFrame([(*key, *now)], columns=names)

    importable(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, schema]))

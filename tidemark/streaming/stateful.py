"""Folds per key that keep their state between micro-batches."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.workers import importable


def keyed_fold(stream: DataFrame, key: str, order: str, state_schema: str, initial: tuple, fold: Callable[[tuple, Any], tuple], ttl_ms: int | None = None) -> DataFrame:
    """``state = fold(state, row)`` for each key's rows, in ``order`` within a micro-batch; gives (key, state) after each batch.

    State lives in Spark's state store. With ``ttl_ms`` (processing time) a key that gets no row for so long starts anew.
    """

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else initial
        frames = list(parts)
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        for row in in_order(rows):
            now = fold(now, row)
        state.update(now)
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield frame_of((*name, *now))

    # For a key with few rows, what pandas does for a frame is most of the work: ``itertuples`` makes a class for each, sorting
    # takes and copies columns, and a new frame infers its types.
    def in_order(rows: pd.DataFrame) -> list[tuple]:
        numbers = rows[order].dtype.kind in "iuf"
        if not numbers:
            rows = rows.sort_values(order, kind="stable")
        found = list(map(record._make, zip(*(rows[c] for c in rows.columns), strict=True)))
        return [found[i] for i in rows[order].to_numpy().argsort(kind="stable")] if numbers else found

    def frame_of(values: tuple) -> pd.DataFrame:
        if not plain:
            return pd.DataFrame([values], columns=names)
        cells = np.empty((1, len(values)), dtype=object)
        cells[0] = values
        return pd.DataFrame(cells, columns=index, copy=False)

    importable(stream.sparkSession)
    names = [key, *[x.split()[0] for x in state_schema.split(",")]]
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {state_schema}"
    record, index = namedtuple("Row", stream.columns, rename=True), pd.Index(names)
    plain = all(f.dataType.typeName() in ("long", "integer", "double", "boolean", "string") for f in StructType.fromDDL(schema))
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(run, schema, state_schema, "update", timeout)


def state_table(spark, checkpoint: str) -> DataFrame:
    """A query's state as a table, to look keys up in."""
    return spark.read.format("statestore").load(checkpoint)

"""Lazy pipelines of map, filter and route steps over a DataFrame, batch or streaming.

Steps are Column expressions, so Catalyst fuses them and pushes filters into the scan; a step may also be a function of
DataFrames. A row for which a mapped value is null is dropped, as a step that returns nothing drops its record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.keys import truthy
from tidemark.workers import importable

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...] = ()

    def _with(self, step: Step) -> Pipeline:
        return Pipeline((*self.steps, step))

    def map(self, **columns: Column) -> Pipeline:
        """Set columns; a row for which one comes out null is dropped."""
        return self._with(lambda df: df.withColumns(columns).where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns], F.lit(True))))

    def select(self, *columns: Column | str) -> Pipeline:
        return self._with(lambda df: df.select(*columns))

    def filter(self, predicate: Column) -> Pipeline:
        """Keep rows for which the predicate is true; null, zero and empty text drop the row. A boolean predicate reaches the scan."""

        def step(df: DataFrame) -> DataFrame:
            kind = df.select(predicate).schema[0].dataType.simpleString()
            return df.where(predicate if kind == "boolean" else truthy(predicate, kind))

        return self._with(step)

    def map_python(self, fn: Callable[[dict], dict | None], schema: str | T.StructType) -> Pipeline:
        """A function of one record as a dict, for what no Column expresses; None drops the record. Rows go to Python in Arrow batches."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = to_arrow_schema(made)
            for part in parts:
                rows = [out for row in part.to_pylist() if (out := fn(row)) is not None]
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

        made = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

        def step(df: DataFrame) -> DataFrame:
            importable(df.sparkSession)
            return df.mapInArrow(run, made)

        return self._with(step)

    def filter_python(self, fn: Callable[[dict], object]) -> Pipeline:
        """Keep records for which a function of the record is true."""
        return self._with(lambda df: Pipeline().map_python(lambda row: row if fn(row) else None, df.schema).build(df))

    def apply(self, fn: Step) -> Pipeline:
        return self._with(fn)

    def route(self, router: Router) -> Pipeline:
        return self._with(router.route)

    def build(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df

    def sink(self, df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
        """Run over a batch and write the result as Parquet."""
        self.build(df).write.mode(mode).partitionBy(*partition_by).parquet(path)


@dataclass
class Router:
    """Topics by ordered predicates: the first that holds wins, else the default topic, else the row is dropped."""

    routes: list[tuple[Column, str]] = field(default_factory=list)
    default: str | None = None

    def add_route(self, predicate: Column, topic: str) -> Router:
        self.routes.append((predicate, topic))
        return self

    def default_route(self, topic: str) -> Router:
        self.default = topic
        return self

    def topic(self) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for predicate, topic in self.routes:
            out = out.when(predicate, F.lit(topic))
        return out.otherwise(F.lit(self.default).cast("string"))

    def route(self, df: DataFrame, name: str = "topic") -> DataFrame:
        return df.withColumn(name, self.topic()).where(F.col(name).isNotNull())

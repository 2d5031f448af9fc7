"""What the corpus operators share: table access, shared-folder tables, let-bindings and column naming."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import drop_tables, keep_only, materialize, new_path, tables  # noqa: F401
from tidemark.workers import importable

#: ASCII white space: a word of the contracts is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
#: Prefix of helper columns, so that they can't clash with those of a caller.
OWN = "__tm_"
#: Bytes of an Arrow batch sent to a Python worker: bounds what a worker holds, however long the texts are.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows and bytes of a table that a join may broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def sized(table: DataFrame, width: int = 1, rows: int | None = None) -> DataFrame:
    """A table as the other side of a join: broadcast up to ``BROADCAST_ROWS / width`` rows (``width`` for rows that take
    more) and ``BROADCAST_BYTES`` of strings, lists and the like, by count and not by compressed size; beyond that, both sides are
    shuffled and merged, and adaptive execution splits skewed keys. ``rows`` is a bound that is known, of a table of numbers;
    else a written table is counted."""
    if rows is None:
        n, held = table.agg(F.count("*"), F.sum(_weight(table))).first()
    else:
        n, held = rows, 0
    return F.broadcast(table) if n <= BROADCAST_ROWS // width and (held or 0) <= BROADCAST_BYTES else table.hint("merge")


def _weight(table: DataFrame) -> Column:
    """Bytes of a row's columns without a fixed size, about."""
    out = F.lit(0)
    for f in table.schema.fields:
        at = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out += F.coalesce(F.octet_length(at), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out += F.coalesce(F.length(F.to_json(F.struct(at))), F.lit(0))
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that long texts don't fill a worker; and let workers import us. A
    bound that the caller has set lower stays. It must hold when a lazy result runs, so it stays set."""
    importable(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"\d+\Z", str(spark.conf.get(key)))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def map_rows(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` under bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas, where Catalyst would inline it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]++", -1))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) fixed by the keys: 52 bits of their hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")

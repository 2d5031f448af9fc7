"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a narrow table.
FILE_ROWS = 100_000

#: Options to write many small files with. On a local or mounted folder, Hadoop's checksummed file system makes two files of
#: each, and starts a process (chmod, where its native library is missing) for both, which takes longer than writing them; this
#: one makes one. Parquet's pages have checksums of their own. Other stores have other schemes and aren't touched.
SMALL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_LISTED: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def one_machine(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's own process, so that its local folders are theirs."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A folder of our own stands in where the session
    names none and all tasks run on this machine; elsewhere executors would write to disks of their own, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not one_machine(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or f"{tempfile.gettempdir()}/tidemark-checkpoints").rstrip("/")


@contextmanager
def tables() -> Iterator[list[str]]:
    """Lists the tables that are written inside the block by this thread, oldest first."""
    found: list[str] = []
    token = _LISTED.set(found)
    try:
        yield found
    finally:
        _LISTED.reset(token)


def new_path(spark: SparkSession, name: str, listed: bool = True) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if listed and (found := _LISTED.get()) is not None:
        found.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors, stays columnar. Where a bound
    of its ``rows`` is known, so many files as they fill are written, not one for each partition of a shuffle.

    All tables lie in ``<spark.checkpoint.dir>/<application id>/``, which may go when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"can't move {source} to {target}")


def write_once(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a folder unless it has been written whole before, so that work which runs again adds nothing."""
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").format(format).save(path)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that no frame in use reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keep_only(result: DataFrame, written: list[str]) -> DataFrame:
    """``result``, after those of the tables in ``written`` are gone that it doesn't read."""
    read = {f.split("/")[-2] for f in result.inputFiles()} if written else set()
    drop_tables(result.sparkSession, [p for p in written if p.split("/")[-1] not in read])
    return result

"""Command line: ``python -m tidemark.cli COMMAND``, over topics and logs on storage."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import delivery
from tidemark.sources import commit_log
from tidemark.sources.commit_log import CommitLog
from tidemark.storage import children, drop_tables, exists, move


def show(df: DataFrame) -> list[str]:
    return [json.dumps(json.loads(x), sort_keys=True) for x in df.toJSON().collect()]


def inspect(spark: SparkSession, path: str, partition: int, limit: int, tail: bool) -> list[str]:
    log = CommitLog(spark, path).read()
    rows = commit_log.tail(log.where(F.col("partition") == partition), limit).orderBy("offset") if tail else commit_log.head(log, partition, limit)
    return show(rows.limit(limit))


def dlq_inspect(spark: SparkSession, path: str, limit: int, seq: str) -> list[str]:
    return show(spark.read.parquet(path).orderBy(seq).limit(limit))


def _replace(spark: SparkSession, made: str, path: str) -> None:
    drop_tables(spark, [path])
    move(spark, made, path)


def _finish(spark: SparkSession, path: str, target: str | None) -> None:
    """Carry a change that was cut short to its end, once all of it is written; drop one that isn't."""
    again, rest = f"{path}.replay", f"{path}.rest"
    whole = [exists(spark, f"{p}/_SUCCESS") for p in (again, rest)]
    if whole[0] and target:
        for name in children(spark, again):
            if name.startswith("part-"):
                spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(target))
                move(spark, f"{again}/{name}", f"{target.rstrip('/')}/{name}")
    if whole[1] and (whole[0] or not exists(spark, path)):
        _replace(spark, rest, path)
    drop_tables(spark, [again, rest])


def dlq_replay(spark: SparkSession, path: str, target: str, limit: int, seq: str) -> int:
    """Append the oldest dead letters to their topic again, without metadata; the folder keeps the rest. Both are written beside it
    before either is put in place, so a replay that is cut short is finished by the next one, and nothing is lost or sent twice."""
    path = path.rstrip("/")
    _finish(spark, path, target)
    again, rest = delivery.replay(spark.read.parquet(path), seq, limit)
    rest.write.mode("overwrite").parquet(f"{path}.rest")
    again.write.mode("overwrite").parquet(f"{path}.replay")
    count = spark.read.parquet(f"{path}.replay").count()
    _finish(spark, path, target)
    return count


def dlq_purge(spark: SparkSession, path: str) -> None:
    path = path.rstrip("/")
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(f"{path}.new")
    _replace(spark, f"{path}.new", path)


def groups(spark: SparkSession, path: str) -> list[str]:
    return show(spark.read.parquet(path).groupBy("group").agg(F.sum("committed").alias("committed")).orderBy("group"))


def reset(spark: SparkSession, path: str, group: str, to: str) -> None:
    """Move a group's offsets in a table of (group, topic, partition, committed)."""
    path = path.rstrip("/")
    delivery.reset_offsets(spark.read.parquet(path), group, to).write.mode("overwrite").parquet(f"{path}.new")
    _replace(spark, f"{path}.new", path)


def status(spark: SparkSession) -> list[str]:
    """Streaming queries of this session, with their last progress."""
    return [json.dumps({"id": str(q.id), "name": q.name, "active": q.isActive, "rows": (q.lastProgress or {}).get("numInputRows", 0)}) for q in spark.streams.active]


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("inspect", "dlq-inspect", "dlq-replay", "dlq-purge", "groups", "reset"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--limit", type=int, default=100 if name == "dlq-replay" else 10)
        p.add_argument("--seq", default="offset")
        p.add_argument("--target")
        p.add_argument("--group")
        p.add_argument("--to", default="0")
        p.add_argument("--partition", type=int, default=0)
        p.add_argument("--tail", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    out = {
        "inspect": lambda: inspect(spark, a.path, a.partition, a.limit, a.tail),
        "dlq-inspect": lambda: dlq_inspect(spark, a.path, a.limit, a.seq),
        "dlq-replay": lambda: [str(dlq_replay(spark, a.path, a.target, a.limit, a.seq))],
        "dlq-purge": lambda: dlq_purge(spark, a.path) or [],
        "groups": lambda: groups(spark, a.path),
        "reset": lambda: reset(spark, a.path, a.group, a.to) or [],
    }[a.command]()
    print("\n".join(out))


if __name__ == "__main__":
    main()

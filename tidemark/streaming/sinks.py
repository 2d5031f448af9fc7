"""Sinks for ``foreachBatch`` that write each event once."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sinks import first_writes, new_tokens, with_token, writes_with_ttl
from tidemark.storage import children, drop_tables, exists
from tidemark.workers import importable

Transport = Callable[[str, bytes, dict[str, str], float], int]


class IdempotentTable:
    """Appends events whose token isn't in the table yet; a batch's folder is overwritten, so its replay adds nothing.

    With ``ttl_ms`` a token is forgotten so long after its last write, by the event times in column ``at``. Tokens are kept beside
    the table: those of each batch, and every ``merge_every`` batches all that are still known as one table, so a batch lists no
    more folders than that, and forgotten tokens go.
    """

    def __init__(self, name: str, path: str, event_id: str = "event_id", order: str | None = None, ttl_ms: int | None = None, at: str | None = None, merge_every: int = 16):
        if (ttl_ms is None) != (at is None):
            raise ValueError("a time to live needs the column of event times, and the other way round")
        self.name, self.path, self.event_id, self.order = name, path.rstrip("/"), event_id, order or event_id
        self.ttl_ms, self.at, self.merge_every = ttl_ms, at, merge_every

    @property
    def _tokens(self) -> str:
        return f"{self.path}.tokens"

    def written(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """(token, last_ms) of what was written before a batch."""
        names = children(spark, self._tokens)
        bases = [int(n[5:]) for n in names if n.startswith("base=") and int(n[5:]) <= batch_id and exists(spark, f"{self._tokens}/{n}/_SUCCESS")]
        base = max(bases, default=0)
        paths = [f"{self._tokens}/base={base}"] * bool(bases) + [f"{self._tokens}/{n}" for n in names if n.startswith("batch=") and base <= int(n[6:]) < batch_id]
        if not paths:
            return spark.createDataFrame([], "token string, last_ms long")
        return spark.read.schema("token string, last_ms long").parquet(*paths).groupBy("token").agg(F.max("last_ms").alias("last_ms"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, rows = self.written(spark, batch_id), with_token(batch, self.name, F.col(self.event_id))
        if self.ttl_ms is None:
            fresh = new_tokens(first_writes(rows, ["token"], self.order), before)
        else:
            rows = rows.withColumn("__ms", F.col(self.at).cast("long"))
            due = writes_with_ttl(rows, ["token"], "__ms", self.ttl_ms, before.withColumnRenamed("last_ms", "__ms"))
            fresh = first_writes(rows.join(due, ["token", "__ms"], "left_semi"), ["token", "__ms"], self.order)
        fresh.drop("__ms").write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        stamp = F.lit(0).cast("long") if self.at is None else F.max(F.col(self.at).cast("long"))
        now = spark.read.parquet(f"{self.path}/batch_id={batch_id}").groupBy("token").agg(F.max(stamp).alias("last_ms") if self.at is None else stamp.alias("last_ms"))
        now.write.mode("overwrite").parquet(f"{self._tokens}/batch={batch_id}")
        if (batch_id + 1) % self.merge_every == 0:
            self._merge(batch, batch_id)

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = self.written(spark, batch_id + 1)
        if self.ttl_ms is not None and (first := batch.agg(F.min(F.col(self.at).cast("long"))).first()[0]) is not None:
            known = known.where(F.col("last_ms") + self.ttl_ms >= first)
        known.write.mode("overwrite").parquet(f"{self._tokens}/base={batch_id + 1}")
        last = batch_id + 1 - self.merge_every  # a batch that runs again needs what was there before it
        drop_tables(spark, [f"{self._tokens}/{n}" for n in children(spark, self._tokens) if int(n.partition("=")[2]) < last])


def http_transport(url: str, body: bytes, headers: dict[str, str], timeout: float) -> int:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as reply:
        return reply.status


class HttpSink:
    """Posts each event as JSON with its token as idempotency key, from the executors; a reply outside 2xx fails the batch,
    which Spark then runs again, and the receiver tells repeats by the key. With ``path``, what was posted is written there, and a
    batch that runs again posts only the rest."""

    def __init__(self, name: str, url: str, event_id: str = "event_id", timeout: float = 5.0, transport: Transport = http_transport, path: str | None = None):
        self.name, self.url, self.event_id, self.timeout, self.transport, self.path = name, url, event_id, timeout, transport, path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = with_token(batch, self.name, F.col(self.event_id)).select("token", F.to_json(F.struct(*batch.columns)).alias("body"))
        importable(spark)
        url, timeout, post = self.url, self.timeout, self.transport
        tries = [] if self.path is None else [f"{self.path}/batch={batch_id}/{n}" for n in children(spark, f"{self.path}/batch={batch_id}")]
        if tries:
            rows = new_tokens(rows, spark.read.schema("token string, status int").parquet(*tries).where("status between 200 and 299"))

        def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                status = [post(url, json.dumps(json.loads(body)).encode(), {"Content-Type": "application/json", "X-Idempotency-Key": token}, timeout) for token, body in zip(part["token"], part["body"], strict=True)]
                yield pd.DataFrame({"token": part["token"], "status": status})

        sent = rows.mapInPandas(send, "token string, status int")
        if self.path is not None:
            at = f"{self.path}/batch={batch_id}/try={len(tries) + 1}"
            sent.write.mode("overwrite").parquet(at)
            sent = spark.read.parquet(at)
        bad = sent.where("status not between 200 and 299").groupBy("status").count().collect()
        if bad:
            raise RuntimeError(f"{url} answered " + ", ".join(f"{r['status']} to {r['count']} events" for r in bad))

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))
import sequential

from tidemark.functions import keys as K
from tidemark.operators import cluster, delivery, metrics, sinks, state
from tidemark.operators import validation as V
from tidemark.plans.pipeline import Pipeline, Router
from tidemark.sources import commit_log
from tidemark.sources.commit_log import CommitLog


def test_pipeline_and_router(spark):
    df = spark.range(10)
    assert [r.id for r in Pipeline().map(v=F.col("id")).filter(F.col("v") > 5).build(df).collect()] == [6, 7, 8, 9]
    assert Pipeline().map(v=F.when(F.col("id") > 7, F.col("id"))).build(df).count() == 2
    made = Pipeline().map_python(lambda r: {"v": r["id"] * 2} if r["id"] % 2 else None, "v long").filter_python(lambda r: r["v"] > 5).build(df)
    assert sorted(r.v for r in made.collect()) == [6, 10, 14, 18]
    tx = spark.createDataFrame([("tx-1", 50.0), ("tx-2", 15000.0), ("tx-3", 500.0), ("tx-4", None)], "id string, amount double")
    router = Router().add_route(F.col("amount") > 10000, "high").add_route(F.col("amount") > 0, "standard")
    assert {r.id: r.topic for r in router.route(tx).collect()} == {"tx-1": "standard", "tx-2": "high", "tx-3": "standard"}
    assert router.default_route("rest").route(tx).where("topic = 'rest'").first().id == "tx-4"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).withColumn("w", F.lit(1)).write.parquet(str(tmp_path / "t"))
    plan = Pipeline().filter(F.col("id") > 5).select("id").build(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "struct<id:bigint>" in plan


def test_validation(spark):
    df = spark.createDataFrame([(1, 2, "A"), (2, 0, "A"), (3, None, "X")], "id long, quantity int, flag string")
    good, bad = V.validate_split(df, {"quantity": F.col("quantity") > 0, "flag": F.col("flag") == "A"})
    assert [r.id for r in good.collect()] == [1] and {r.id: r._error for r in bad.collect()} == {2: "quantity", 3: "quantity"}
    schema = V.Schema(T.StructType([T.StructField("amount", T.LongType()), T.StructField("unit", T.StringType())]), defaults={"unit": F.lit("USD")}, aliases={"amount": "value"})
    rows = spark.createDataFrame([('{"amount": 1}',), ('{"value": 2, "unit": "EUR"}',), ("{broken",)], "j string")
    assert [r.body and tuple(r.body) for r in V.decode(rows, "j", schema).collect()] == [(1, "USD"), (2, "EUR"), None]
    registry = V.SchemaRegistry()
    registry.register("known", schema)
    kinds = spark.createDataFrame([("known",), ("UnknownType",)], "t string")
    assert [r[0] for r in kinds.select(registry.model(F.col("t"))).collect()] == ["known", "BaseEvent"]
    assert V.compatible(T.StructType(schema.type.fields[:1]), schema.type) and not V.compatible(schema.type, T.StructType(schema.type.fields[:1]))
    made = V.envelope(kinds, F.lit(None), F.current_timestamp(), F.lit("{}"), F.when(F.col("t") == "known", F.col("t")))
    assert {r.event_type for r in made.collect()} == {"known", "GenericEvent"} and made.where("event_id is null").count() == 0


def test_state(spark):
    puts = spark.createDataFrame([("a", 1, 1, 0, None, False), ("a", 2, 2, 0, 10, False), ("b", 3, 1, 0, None, True)], "k string, v int, seq int, put_ms long, ttl int, gone boolean")
    now = state.latest(puts, ["k"], "seq", "gone")
    assert [(r.k, r.v) for r in now.collect()] == [("a", 2)]
    assert state.alive(now, "put_ms", "ttl", 10_000).count() == 1 and state.alive(now, "put_ms", "ttl", 10_001).count() == 0
    wanted = spark.createDataFrame([("a",), ("z",)], "k string")
    assert {r.k: r.v for r in state.get(wanted, now, ["k"], "v", F.lit(-1)).collect()} == {"a": 2, "z": -1}
    commits = spark.createDataFrame([("s", "g", 5, 1), ("s", "g", 3, 2)], "stream string, group string, msg_id long, seq int")
    assert state.checkpoints(commits, "seq").first().msg_id == 3  # a rewind counts
    messages = spark.createDataFrame([("s", i) for i in range(8, 12)], "stream string, id long")
    marks = spark.createDataFrame([("s", 9)], "stream string, at long")
    assert sorted(r.id for r in state.after_checkpoint(messages, marks, ["stream"], "id", "at").collect()) == [10, 11]
    total = state.running(messages, ["stream"], ["id"], "total", F.sum("id"))
    assert total.agg(F.max("total")).first()[0] == 38


def test_idempotent_writes(spark):
    df = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 3)], "event_id string, seq int")
    once = sinks.with_token(sinks.first_writes(df, ["event_id"], "seq"), "s", F.col("event_id"))
    assert sorted(r.token for r in once.collect()) == ["tidemark:sink:s:e1", "tidemark:sink:s:e2"]
    r = random.Random(2)
    rows = sorted({(r.choice("ab"), r.randint(0, 500)) for _ in range(150)})
    got = sinks.writes_with_ttl(spark.createDataFrame(rows, "k string, ms long"), ["k"], "ms", 20)
    assert sorted(map(tuple, got.collect())) == sequential.replay_ttl(rows, 20)


def test_retries_and_dead_letters(spark):
    df = spark.createDataFrame([("m1", 1), ("m2", 3)], "msg_id string, attempts long")
    assert [r.outcome for r in delivery.retry_outcomes(df, max_retries=2).orderBy("msg_id").collect()] == ["retry", "dead_letter"]
    failures = spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 3), ("m3", 4), ("m3", 6)], "msg_id string, seq long")
    acked = spark.createDataFrame([("m1", 3), ("m3", 5)], "msg_id string, seq long")
    assert sorted(tuple(r) for r in delivery.attempt_counts(failures, acked).collect()) == [("m2", 1), ("m3", 1)]
    dlq = delivery.dead_letters(df.withColumn("seq", F.col("attempts")), F.lit("boom"), F.lit("orders"), F.col("msg_id"), F.lit(7))
    assert set(dlq.columns) >= {"_error", "_original_stream", "_original_msg_id", "_moved_timestamp"}
    again, rest = delivery.replay(dlq, "seq", 1)
    assert again.columns == ["msg_id", "attempts", "seq"] and again.first().msg_id == "m1" and rest.first().msg_id == "m2"
    assert [r[0] for r in spark.range(1, 5).select(K.backoff_seconds(F.col("id"))).collect()] == [1, 2, 4, 8]


def test_lag_offsets_and_claims(spark):
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, 4)], "topic string, partition int, end long")
    committed = spark.createDataFrame([("t", 0, 12)], "topic string, partition int, committed long")
    assert {r.partition: r.lag for r in delivery.lag(ends, committed, ["topic", "partition"]).collect()} == {0: 0, 1: 4}
    offsets = spark.createDataFrame([("g", "t", 0, 3), ("h", "t", 0, 3)], "group string, topic string, partition int, committed long")
    assert {r.group: r.committed for r in delivery.reset_offsets(offsets, "g", "$", ends).collect()} == {"g": 10, "h": 3}
    assert {r.group: r.committed for r in delivery.reset_offsets(offsets, "g", "0").collect()} == {"g": 0, "h": 3}
    with pytest.raises(ValueError):
        delivery.reset_offsets(offsets, "g", "$")
    pending = spark.createDataFrame([(1, 0), (2, 50_000)], "seq long, delivered_ms long")
    assert [r.seq for r in delivery.claim_stuck(pending, 60_000).collect()] == [1]
    ids = spark.createDataFrame([("5-10",), ("5-9",), ("12",)], "id string").select(K.parse_message_id(F.col("id")).alias("id"))
    assert [tuple(r.id) for r in ids.orderBy("id").collect()] == [(5, 9), (5, 10), (12, 0)]


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), partitions=2, segment_rows=3)
    for start in (0, 10):
        log.append(spark.range(start, start + 10).withColumn("ms", F.col("id")), F.col("id"), ["id"])
    rows = log.read()
    assert {r.partition: r.high_watermark for r in commit_log.high_watermark(rows).collect()} == {r.partition: r.n for r in rows.groupBy("partition").agg(F.count("*").alias("n")).collect()}
    for p in (0, 1):
        offsets = [r.offset for r in rows.where(F.col("partition") == p).orderBy("id").collect()]
        assert offsets == list(range(len(offsets)))
        assert len(list((tmp_path / "log" / f"partition={p}").glob("*.parquet"))) > 1
    assert "PartitionFilters: [isnotnull(partition" in commit_log.scan(rows, 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert commit_log.tail(rows, 2).count() == 4 and commit_log.head(rows, 0, 3).count() == 3
    broken = commit_log.recovered(rows, F.col("id") != 4)
    lost = rows.where("id = 4").first()
    assert broken.where(F.col("partition") == lost.partition).count() == lost.offset
    follower = rows.where("offset < 2")
    assert commit_log.catch_up(rows, follower, 3).groupBy("partition").agg(F.min("offset").alias("o"), F.count("*").alias("n")).where("o != 2 or n != 3").count() == 0
    kept = commit_log.retained(rows, F.floor(F.col("offset") / 3), "ms", 10**9)
    assert kept.count() > 0 and kept.agg(F.min("offset")).first()[0] > 0


def test_cluster(spark):
    claims = spark.createDataFrame([(0, "a", 1, 5), (0, "b", 5, 50), (1, "a", 1, 50), (1, "c", 2, 50)], "partition int, node_id string, claimed_ms long, expires_ms long")
    leases = cluster.live_leases(claims, 10)
    assert {r.partition: r.node_id for r in leases.collect()} == {0: "b", 1: "a"}
    nodes = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 2)], "node_id string, host string, port int")
    many = spark.createDataFrame([(i, "a", 99) for i in range(5)], "partition int, node_id string, expires_ms long")
    assert {r.node_id: (r.held, r.fair_share, r.release) for r in cluster.fair_share(many, nodes).collect()} == {"a": (5, 3, 1), "b": (0, 3, 0)}
    assert cluster.peers(nodes, "a").first().node_id == "b" and cluster.leaders(leases, nodes).count() == 2
    assert {r.node_id: r.partitions for r in cluster.status(many, nodes).collect()} == {"a": [0, 1, 2, 3, 4], "b": []}


def test_metrics(spark):
    df = spark.createDataFrame([("s", "success", 0.05, 0), ("s", "success", 9.0, 0), ("s", "dead_letter", None, 0), ("s", "error", None, 0)], "stream string, status string, seconds double, ms long")
    assert {r.status: r.total for r in metrics.processed(df).collect()} == {"success": 2, "error": 2, "dead_letter": 1}
    assert {r.le: r.n for r in metrics.histogram(df, "seconds").collect()} == {"0.01": 0, "0.05": 1, "0.1": 1, "0.5": 1, "1.0": 1, "5.0": 1, "+Inf": 2}
    assert metrics.error_ratio(df, F.col("ms"), 1000).first().firing and metrics.rates(df, F.col("ms"), 1000).count() == 3
    assert not metrics.lag_alert(spark.createDataFrame([(1000,)], "lag long")).first().firing
    assert metrics.worker_alert(spark.createDataFrame([(0,)], "status int")).first().firing


def test_keys(spark):
    row = spark.range(1).select(K.partition_of(F.lit("abc"), 4), K.key_or_default(F.lit(None)), K.state_key(F.lit("t"), F.lit("k"), F.lit(0), F.lit(10000)), K.truthy(F.lit(""), "string"), K.truthy(F.lit(2), "int")).first()
    import zlib

    assert tuple(row) == (zlib.crc32(b"abc") % 4, "default_key", "t:k:0.0:10.0", False, True)


def test_nan_stays_null_goes_and_text_is_truthy(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, None, ""), (3, 1.5, None)], "id int, v double, t string")
    assert [r.id for r in Pipeline().map(w=F.col("v") * 2).build(df).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in Pipeline().filter(F.col("t")).build(df).collect()] == [1]


def test_quantile_of_any_bucket_bounds(spark):
    from tidemark.operators import metrics

    rows = spark.createDataFrame([("s", x) for x in (0.0005, 0.004, 400.0, 900.0)], "stream string, seconds double").withColumn("status", F.lit("success"))
    found = metrics.quantile(metrics.histogram(rows, "seconds", (0.001, 0.005, 1000.0)), ["stream"], 0.75).first()
    assert abs(found["value"] - (0.005 + (1000 - 0.005) / 2)) < 1e-9


def test_a_claim_under_a_live_lease_is_refused_for_good(spark):
    claims = spark.createDataFrame([(0, "a", 0, 10), (0, "b", 5, 100), (0, "c", 10, 20), (0, "c", 15, 30), (1, "a", 0, 10)], "partition int, node_id string, claimed_ms long, expires_ms long")
    at = lambda ms: [tuple(r) for r in cluster.live_leases(claims, ms).collect()]
    assert at(7) == [(0, "a", 10), (1, "a", 10)] or sorted(at(7)) == [(0, "a", 10), (1, "a", 10)]
    assert at(12) == [(0, "c", 20)] and at(25) == [(0, "c", 30)] and at(50) == []

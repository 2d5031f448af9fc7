import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.time import Tumbling
from tidemark.settings import Settings
from tidemark.sources import backends
from tidemark.sources.lines import LineSource, lines, whole_size
from tidemark.streaming.sinks import HttpSink, IdempotentTable
from tidemark.streaming.stream import Stream, union

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("ms", T.LongType())])


@pytest.fixture(scope="module")
def registered(spark):
    spark.dataSource.register(LineSource)
    return spark


def test_line_source_in_ranges_and_as_stream(registered, tmp_path):
    spark, path = registered, tmp_path / "log.ndjson"
    rows = [json.dumps({"i": i, "t": "é" * (i % 7)}) for i in range(200)]
    path.write_text("\n".join([*rows[:50], "{broken", *rows[50:]]) + "\n" + '{"half": ', encoding="utf-8")
    batch = spark.read.format("tidemark_lines").option("path", str(path)).option("bytes_per_partition", 97).load()
    got = batch.orderBy("offset").collect()
    assert [json.loads(r.line)["i"] for r in got] == list(range(200))
    from_there = spark.read.format("tidemark_lines").option("path", str(path)).option("starting_offset", got[120].offset).load()
    assert from_there.count() == 80
    assert list(lines(str(path), 5, 5)) == [] and whole_size(str(tmp_path / "none")) == 0
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("tidemark_lines").option("path", str(path)).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 200
    with path.open("a", encoding="utf-8") as f:
        f.write('1}\n{"i": 200}\n')
    run()
    assert spark.read.parquet(out).count() == 202


def test_file_backend(spark, tmp_path):
    topic = backends.open_topic(spark, "orders", "g", "file", SCHEMA, path=str(tmp_path))
    assert topic.read().count() == 0 and topic.ping()
    topic.append(spark.range(5).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type"), F.lit(0).alias("ms")))
    (tmp_path / "orders" / "part-x.json").write_text('{"event_id": 9, "event_type": "y", "ms": 1}\nnot json\n')
    assert sorted(r.event_id for r in topic.read().collect()) == [0, 1, 2, 3, 4, 9]
    assert topic.with_topic("other").read().count() == 0 and topic.dead_letters().topic == "orders-dlq" and topic.late().topic == "orders-late"


def test_registry(spark, monkeypatch):
    class Own(backends.MemoryBackend):
        pass

    class Entry:
        def __init__(self, name, load):
            self.name, self._load = name, load

        def load(self):
            return self._load()

    monkeypatch.setattr(backends, "_loaded", False)
    backends.load_plugins(lambda group: [Entry("bad", lambda: 1 / 0), Entry("good", lambda: lambda register: register("own", Own))])
    assert backends.get_backend("own") is Own and backends.get_backend("none") is None
    with pytest.raises(ValueError):
        backends.open_topic(spark, None, "g")
    with pytest.raises(ValueError):
        backends.open_topic(spark, "t", "g", "nothing")
    topic = backends.open_topic(spark, "m", "g")
    topic.append(spark.range(3))
    topic.append(spark.range(2))
    assert topic.read().count() == 5 and isinstance(topic, backends.MemoryBackend)


def test_stream_of_handlers(spark, tmp_path):
    source = backends.open_topic(spark, "in", "g", "log", SCHEMA, path=str(tmp_path / "topics"))
    rows = spark.range(20).select(F.col("id").alias("event_id"), F.when(F.col("id") != 3, F.lit("t")).alias("event_type"), (F.col("id") * 1000).alias("ms"))
    source.append(rows)
    stream, seen = Stream(spark, source, str(tmp_path / "ck")), []

    @stream.subscribe(checks={"event_type": F.col("event_type").isNotNull()})
    def keep(batch, batch_id, context):
        seen.append((batch_id, batch.count()))
        context.emit(batch.select("event_id", F.lit(None).cast("string").alias("event_type"), "ms"), "out")

    @stream.subscribe()
    def count(batch):
        seen.append(("all", batch.count()))

    splitter = stream.window(Tumbling(5000), "ms", ["event_id"], str(tmp_path / "w"), delay_ms=1)
    with stream:
        stream.run()
        assert stream.health()["status"] == "ok"
    assert sorted(map(str, seen)) == ["('all', 20)", "(0, 19)"]
    assert {r.event_type for r in source.with_topic("out").read().collect()} == {"GenericEvent"}
    dead = spark.read.parquet(str(tmp_path / "topics" / "in-dlq") + "/*").first()
    assert dead.event_id == 3 and dead._error == "event_type" and dead._original_stream == "in"
    assert splitter.on_time(spark).count() == 20 and splitter.late(spark).count() == 0
    again = Stream(spark, source, str(tmp_path / "ck"))
    again.subscribe()(lambda batch: seen.append(batch.count()))
    again.subscribe()(lambda batch: seen.append(batch.count()))
    again.run()
    assert 20 not in seen  # the group goes on where it stopped
    assert union([rows, rows.drop("ms")]).count() == 40


def _ten(spark, path):
    source = backends.open_topic(spark, "in", "g", "log", SCHEMA, path=str(path))
    source.append(spark.range(10).select(F.col("id").alias("event_id"), F.lit("t").alias("event_type"), F.lit(0).cast("long").alias("ms")))
    return source


def test_failed_batch_is_tried_again_then_dead(spark, tmp_path):
    source, calls, waits = _ten(spark, tmp_path / "topics"), [], []

    def handler(fails):
        def run(batch):
            calls.append(batch.count())
            if len(calls) <= fails:
                raise RuntimeError("down")

        return run

    first = Stream(spark, source, str(tmp_path / "ck"), max_retries=2, delay=lambda n: waits.append(n) or 0.0)
    first.subscribe()(handler(2))
    first.run()
    assert calls == [10] * 3 and waits == [1, 2] and first.health()["status"] == "ok"
    calls.clear()
    second = Stream(spark, source, str(tmp_path / "ck2"), max_retries=2, delay=lambda n: 0.0)
    second.subscribe()(handler(99))
    second.run()
    dead = spark.read.parquet(str(tmp_path / "topics" / "in-dlq") + "/*").collect()
    assert calls == [10] * 3 and sorted(r.event_id for r in dead) == list(range(10)) and {r._error for r in dead} == {"RuntimeError: down"}


def test_failing_records_survive_a_crash(spark, tmp_path):
    """Records are handled once if they succeed; the count of failures goes on after a crash; dead letters are added once."""
    source, log = _ten(spark, tmp_path / "topics"), str(tmp_path / "handled")

    def handle(record, attempt, log=log):
        with open(log, "a") as f:
            f.write(f"{record['event_id']} {attempt}\n")
        if record["event_id"] == 3 or (record["event_id"] == 5 and attempt < 3):
            raise ValueError(f"no {record['event_id']}")

    def crash(n):
        raise SystemError("the driver dies")

    first = Stream(spark, source, str(tmp_path / "ck"), max_retries=2, delay=crash)
    first.subscribe(each=True, checks={"id": F.col("event_id") != 8})(handle)
    with pytest.raises(Exception, match="the driver dies"):
        first.run()
    for _ in range(2):
        again = Stream(spark, source, str(tmp_path / "ck"), max_retries=2, delay=lambda n: 0.0)
        again.subscribe(each=True, checks={"id": F.col("event_id") != 8})(handle)
        again.run()
    seen = sorted(tuple(map(int, x.split())) for x in open(log).read().splitlines())
    assert seen == sorted([(i, 1) for i in range(10) if i != 8] + [(3, 2), (5, 2), (3, 3), (5, 3)])
    dead = source.with_topic("in").dead_letters()
    dead.schema = None
    assert sorted((r.event_id, r._error) for r in dead.read().collect()) == [(3, "ValueError: no 3"), (8, "id")]


def test_memory_topic_as_a_stream(spark, tmp_path):
    source, seen = backends.MemoryBackend(spark, "memory-in", "g", SCHEMA), []
    source.append(spark.range(4).select(F.col("id").alias("event_id"), F.lit("t").alias("event_type"), F.col("id").alias("ms")))
    stream = Stream(spark, source, str(tmp_path / "ck"))
    stream.subscribe()(lambda batch: seen.append(batch.count()))
    stream.run()
    source.append(spark.range(1).select(F.col("id").alias("event_id"), F.lit("t").alias("event_type"), F.col("id").alias("ms")))
    stream.run()
    assert seen == [4, 1]


def test_backend_of_the_environment_gives_way_to_memory(spark, monkeypatch):
    monkeypatch.setenv("TIDEMARK_BACKEND", "nothing of the kind")
    assert isinstance(backends.open_topic(spark, "t", "g"), backends.MemoryBackend)
    with pytest.raises(ValueError, match="no backend"):
        backends.open_topic(spark, "t", "g", "nothing of the kind")
    monkeypatch.setenv("TIDEMARK_BACKEND", "log")
    monkeypatch.setenv("TIDEMARK_PATH", "/somewhere")
    assert backends.open_topic(spark, "t", "g").location == "/somewhere/t"
    backends.register_state_store("own", "a.b.C")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    backends.use_state_store(spark, "own")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == "a.b.C"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    with pytest.raises(ValueError, match="no state store"):
        backends.use_state_store(spark, "none")


def test_idempotent_sinks(spark, tmp_path):
    sink = IdempotentTable("s", str(tmp_path / "t"))
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "event_id long"), spark.createDataFrame([(2,), (3,)], "event_id long")
    for batch, i in ((a, 0), (b, 1), (b, 1)):
        sink(batch, i)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]
    out = str(tmp_path / "posted")

    def post(url, body, headers, timeout, out=out):
        with open(out, "a") as f:
            f.write(headers["X-Idempotency-Key"] + " " + body.decode() + "\n")
        return 500 if b"99" in body else 200

    HttpSink("h", "http://x", transport=post)(b, 0)
    assert sorted(open(out).read().splitlines()) == ['tidemark:sink:h:2 {"event_id": 2}', 'tidemark:sink:h:3 {"event_id": 3}']
    with pytest.raises(Exception, match="500"):
        HttpSink("h", "http://x", transport=post)(spark.createDataFrame([(99,)], "event_id long"), 0)


def test_posted_events_are_not_posted_again(spark, tmp_path):
    out, down = str(tmp_path / "posted"), tmp_path / "down"
    down.write_text("")

    def post(url, body, headers, timeout, out=out, down=str(down)):
        import os

        if b"99" in body and os.path.exists(down):
            return 503
        with open(out, "a") as f:
            f.write(body.decode() + "\n")
        return 200

    sink = HttpSink("h", "http://x", transport=post, path=str(tmp_path / "log"))
    batch = spark.createDataFrame([(1,), (99,), (2,)], "event_id long").coalesce(1)
    with pytest.raises(RuntimeError, match="503 to 1 events"):
        sink(batch, 0)
    down.unlink()
    sink(batch, 0)
    sink(batch, 0)
    assert sorted(open(out).read().splitlines()) == ['{"event_id": 1}', '{"event_id": 2}', '{"event_id": 99}']


def test_tokens_are_merged_and_forgotten(spark, tmp_path):
    sink = IdempotentTable("s", str(tmp_path / "t"), "k", "n", ttl_ms=10, at="ms", merge_every=2)
    batches = [[("a", 0, 1), ("a", 3, 2), ("b", 5, 3)], [("a", 10, 4), ("a", 11, 5)], [("b", 15, 6), ("c", 40, 7)], [("b", 41, 8)], [("a", 60, 9), ("c", 50, 10)]]
    frames = [spark.createDataFrame(b, "k string, ms long, n long") for b in batches]
    for i, frame in enumerate(frames):
        sink(frame, i)
        sink(frame, i)  # a batch that runs again
    seen = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "ms").collect())
    assert seen == [("a", 0), ("a", 11), ("a", 60), ("b", 5), ("b", 41), ("c", 40)]
    kept = sorted(x.name for x in (tmp_path / "t.tokens").iterdir())
    assert kept == ["base=2", "base=4", "batch=2", "batch=3", "batch=4"]
    assert {r.token[-1] for r in sink.written(spark, 4).collect()} == {"b", "c"}


def test_log_watermarks_after_an_append_that_was_cut_short(spark, tmp_path):
    from tidemark.sources.commit_log import CommitLog, scan

    log = CommitLog(spark, str(tmp_path / "log"), 2, segment_rows=5)
    assert log.high_watermarks().count() == 0
    log.append(spark.range(20), F.col("id"), ["id"])
    log.append(spark.range(20, 30), F.col("id"), ["id"])
    want = {r.partition: r.n for r in log.read().groupBy("partition").agg(F.count("*").alias("n")).collect()}
    assert {r.partition: r.high_watermark for r in log.high_watermarks().collect()} == want and sum(want.values()) == 30
    assert all("log.watermarks/version=2/" in f for f in log.high_watermarks().inputFiles())
    spark.range(1).write.parquet(str(tmp_path / "log.watermarks" / "appending"))  # an append began and never ended
    assert not any("log.watermarks" in f for f in log.high_watermarks().inputFiles())
    log.append(spark.range(30, 40), F.col("id"), ["id"])
    for r in log.read().groupBy("partition").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d"), F.max("offset").alias("m")).collect():
        assert r.n == r.d == r.m + 1
    plan = scan(log.read(), 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition" in plan and "GreaterThanOrEqual(offset,3)" in plan


def test_small_segments_are_one_file_each(spark, tmp_path):
    """Of a segment the log makes its own file only: one of checksums beside it would double the files, and each started a process."""
    from tidemark.sources.commit_log import CommitLog

    log = CommitLog(spark, str(tmp_path / "log"), 2, segment_rows=5)
    for start in (0, 100):
        log.append(spark.range(start, start + 100), F.col("id"), ["id"])
    assert not list((tmp_path / "log").rglob("*.crc"))
    files = log.read().groupBy("partition", F.input_file_name().alias("file")).agg(F.count("*").alias("n"), (F.max("offset") - F.min("offset") + 1).alias("span")).collect()
    assert len(files) == len(list((tmp_path / "log").rglob("*.parquet"))) >= 40
    assert all(r.n == r.span <= 5 for r in files) and sum(r.n for r in files) == 200


def test_a_replay_that_was_cut_short_is_finished(spark, tmp_path):
    from tidemark import cli

    path, target = str(tmp_path / "dlq"), str(tmp_path / "main")
    spark.range(6).select(F.col("id").alias("offset"), F.lit("e").alias("_error")).write.parquet(path)
    # All was written beside the folder, then the process died.
    again, rest = cli.delivery.replay(spark.read.parquet(path), "offset", 2)
    rest.write.parquet(f"{path}.rest")
    again.write.parquet(f"{path}.replay")
    assert cli.dlq_replay(spark, path, target, 2, "offset") == 2
    assert sorted(r.offset for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3]
    assert sorted(r.offset for r in spark.read.parquet(path).collect()) == [4, 5]
    spark.read.parquet(path).limit(0).write.parquet(f"{path}.rest")  # only half of what a replay needs: dropped
    assert cli.dlq_replay(spark, path, target, 9, "offset") == 2 and spark.read.parquet(path).count() == 0


def test_settings_and_cli(spark, tmp_path, capsys):
    from tidemark import cli
    from tidemark.sources.commit_log import CommitLog

    assert Settings.load({"TIDEMARK_BACKEND": "log", "TIDEMARK_BATCH_SIZE": "7"}) == Settings(backend="log", batch_size=7)
    CommitLog(spark, str(tmp_path / "log"), 1).append(spark.range(20), F.col("id"), ["id"])
    assert [json.loads(x)["id"] for x in cli.inspect(spark, str(tmp_path / "log"), 0, 3, True)] == [17, 18, 19]
    spark.range(5).select(F.col("id").alias("offset"), F.lit("e").alias("_error")).write.parquet(str(tmp_path / "dlq"))
    cli.main(["dlq-inspect", str(tmp_path / "dlq"), "--limit", "2"])
    assert capsys.readouterr().out.count("_error") == 2
    assert cli.dlq_replay(spark, str(tmp_path / "dlq"), str(tmp_path / "main"), 3, "offset") == 3
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == 2 and spark.read.parquet(str(tmp_path / "main")).columns == ["offset"]
    cli.dlq_purge(spark, str(tmp_path / "dlq"))
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == 0
    spark.createDataFrame([("g", 3), ("g", 4)], "group string, committed long").write.parquet(str(tmp_path / "off"))
    assert cli.groups(spark, str(tmp_path / "off")) == ['{"committed": 7, "group": "g"}']


def test_subscription_options_reach_the_source(spark, tmp_path):
    source = backends.open_topic(spark, "in", "g", "log", SCHEMA, path=str(tmp_path / "topics"))
    for i in range(3):
        source.append(spark.range(i, i + 1, 1, 1).select(F.col("id").alias("event_id"), F.lit("t").alias("event_type"), F.col("id").alias("ms")))
    stream, seen = Stream(spark, source, str(tmp_path / "ck")), []
    stream.subscribe(maxFilesPerTrigger="1")(lambda batch: seen.append(batch.count()))
    stream.run()
    assert seen == [1, 1, 1]


def test_settings_make_a_stream_and_traces_go_on(spark, tmp_path):
    settings = Settings(backend="log", path=str(tmp_path / "topics"), checkpoints=str(tmp_path / "ck"), max_retries=1)
    stream = Stream.configured(spark, "in", "g", SCHEMA, settings)
    assert stream.backend.location == str(tmp_path / "topics" / "in") and stream.max_retries == 1 and stream.checkpoints == str(tmp_path / "ck")
    rows = spark.range(3).select(F.col("id").alias("event_id"), F.lit("t").alias("event_type"), F.col("id").alias("ms"))
    stream.emit(rows, "out", trace=True)
    first = spark.read.parquet(str(tmp_path / "topics" / "out"))
    stream.emit(first, "next", trace=True)
    a = {r.event_id: r.traceparent.split("-") for r in first.collect()}
    b = {r.event_id: r.traceparent.split("-") for r in spark.read.parquet(str(tmp_path / "topics" / "next")).collect()}
    assert len({x[1] for x in a.values()}) == 3 and all(a[i][1] == b[i][1] and a[i][2] != b[i][2] for i in a)


def test_log_lines_as_json():
    import io
    import logging

    from tidemark.logs import set_up_logging

    out = io.StringIO()
    set_up_logging("json", out)
    try:
        raise KeyError("x")
    except KeyError:
        logging.getLogger("tidemark.test").warning("it is %s", "late", exc_info=True)
    line = json.loads(out.getvalue())
    assert line["message"] == "it is late" and line["level"] == "WARNING" and "KeyError" in line["exception"]
    set_up_logging("text")

import pytest
from pyspark.sql import functions as F

from tidemark.functions.time import Session, Sliding, Tumbling
from tidemark.operators.eventtime import assign_windows, sessions
from tidemark.operators.joins import windowed_join
from tidemark.streaming.windows import distinct_within, joined_within, window_column, windowed


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    df = spark.range(300).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 700 + F.when(F.col("id") % 40 == 0, 30_000).otherwise(0)).alias("ms")).withColumn("at", F.timestamp_millis("ms"))
    df.write.parquet(path)
    return path


def work_through(stream, tmp_path, mode):
    out = []
    query = stream.writeStream.foreachBatch(lambda b, i: out.append(b.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [r for batch in out for r in batch]


def test_windows_of_stream_equal_those_of_batch(spark, rows, tmp_path):
    batch = spark.read.parquet(rows)
    for i, w in enumerate((Tumbling(10_000), Sliding(20_000, 10_000))):
        want = {(r.k, r.start_ms): r.n for r in assign_windows(batch, F.col("ms"), w).groupBy("k", "start_ms").agg(F.count("*").alias("n")).collect()}
        assert {(r.k, r.start_ms): r.n for r in windowed(batch, "at", ["k"], w, 0, F.count("*").alias("n")).collect()} == want
        stream = spark.readStream.schema(batch.schema).parquet(rows)
        got = {(r.k, r.start_ms): r.n for r in work_through(windowed(stream, "at", ["k"], w, 60_000, F.count("*").alias("n")), tmp_path / str(i), "update")}
        assert got == want
    with pytest.raises(ValueError):
        window_column("at", Sliding(1, 2))


def test_sessions_include_their_gap(spark, rows):
    batch = spark.read.parquet(rows)
    ours = sorted(r.n for r in sessions(batch, ["k"], "ms", 2100, [F.count("*").alias("n")]).collect())
    assert sorted(r.n for r in windowed(batch, "at", ["k"], Session(2100), 0, F.count("*").alias("n")).collect()) == ours


def test_distinct_and_join(spark, rows, tmp_path):
    batch = spark.read.parquet(rows)
    stream = spark.readStream.schema(batch.schema).parquet(rows)
    twice = stream.unionByName(stream)
    assert len(work_through(distinct_within(twice, ["id"], "at", 1_000_000), tmp_path / "d", "append")) == 300
    a, b = batch.where("id % 2 = 0"), batch.where("id % 2 = 1")
    want = windowed_join(a, b, ["k"], "ms", "ms", Tumbling(10_000)).count()
    sa, sb = stream.where("id % 2 = 0"), stream.where("id % 2 = 1")
    assert len(work_through(joined_within(sa, sb, ["k"], "at", Tumbling(10_000), 1_000_000), tmp_path / "j", "append")) == want > 0

import random
import sys
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import sequential

from tidemark.functions.time import Session, Sliding, Tumbling, seconds_to_millis
from tidemark.operators.aggregate import ordered_fold, python_fold, window_aggregate
from tidemark.operators.eventtime import active_sessions, assign_windows, sessions, split_late, with_watermark
from tidemark.operators.joins import windowed_join
from tidemark.plans.prefix import dense_numbers, running_max


def windows_of(spark, seconds, assigner):
    df = spark.createDataFrame([(x,) for x in seconds], "s double").withColumn("ms", seconds_to_millis(F.col("s")))
    return [(r.s, r.start_ms, r.end_ms) for r in assign_windows(df, F.col("ms"), assigner).collect()]


def test_tumbling_and_sliding_cases(spark):
    assert windows_of(spark, [12.5, 10.0, 9.9], Tumbling(10000)) == [(12.5, 10000, 20000), (10.0, 10000, 20000), (9.9, 0, 10000)]
    assert windows_of(spark, [12.0], Sliding(10000, 5000)) == [(12.0, 10000, 20000), (12.0, 5000, 15000)]
    assert windows_of(spark, [3.0], Sliding(2000, 5000)) == []
    assert windows_of(spark, [3.0], Session(2000)) == [(3.0, 3000, 5000)]
    with pytest.raises(ValueError):
        Tumbling(0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 200), min_size=1, max_size=20), st.integers(1, 30), st.integers(1, 30))
def test_sliding_against_replay(spark, times, size, slide):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(times)], "i long, ms long")
    got = sorted((r.i, r.start_ms, r.end_ms) for r in assign_windows(df, F.col("ms"), Sliding(size, slide)).collect())
    assert got == sorted((i, *w) for i, x in enumerate(times) for w in sequential.sliding(x, size, slide))


@pytest.mark.parametrize("delay", [0, 5, 40])
@pytest.mark.parametrize("assigner", [Tumbling(10), Sliding(20, 10)])
def test_late_rows_against_replay(spark, delay, assigner):
    r = random.Random(delay)
    times = [i * 3 + r.randint(-60, 0) + 100 for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i long, ms long")
    on_time, late = split_late(df, "ms", ["i"], assigner, delay)
    assign = (lambda t: sequential.tumbling(t, 10)) if isinstance(assigner, Tumbling) else lambda t: sequential.sliding(t, 20, 10)
    want = sequential.replay_late(times, assign, delay)
    assert sorted((x.i, x.start_ms) for x in late.collect()) == sorted((i, w[0]) for i, w, is_late in want if is_late)
    assert on_time.count() == sum(not is_late for _, _, is_late in want)


def test_running_max_and_dense_numbers_over_many_ranges(spark):
    r = random.Random(3)
    values = [(i, r.randint(0, 10**6), r.choice("aab")) for i in range(3000)]
    df = spark.createDataFrame(values, "i long, v long, k string")
    top, want = 0, {}
    for i, v, _ in values:
        top = max(top, v)
        want[i] = top
    assert {x.i: x.m for x in running_max(df, F.col("v"), ["i"], "m", 7).collect()} == want
    seen, numbers = {}, {}
    for i, _, k in values:
        numbers[i] = seen.get(k, 0)
        seen[k] = numbers[i] + 1
    assert {x.i: x.n for x in dense_numbers(df, ["k"], ["i"], "n", 7).collect()} == numbers


def test_sessions_both_modes(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), i * 4 + r.randint(-30, 0)) for i in range(300)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i long, k string, t long")
    got = sessions(df, ["k"], "t", 10, [F.count("*").alias("n")], "arrival", ["i"])
    want = sequential.replay_sessions(rows, 10)
    assert {(x.k, x.session_id): x.n for x in got.collect()} == want
    assert {(x.k, x.session_id) for x in active_sessions(got, ["k"]).collect()} == {(k, max(n for q, n in want if q == k)) for k, _ in want}
    by_time = sessions(df, ["k"], "t", 10, [F.count("*").alias("n")])
    assert {(x.k, x.session_id): x.n for x in by_time.collect()} == sequential.replay_sessions(sorted(rows, key=lambda x: x[1]), 10)
    edge = spark.createDataFrame([(0, "a", 0), (1, "a", 10), (2, "a", 21)], "i long, k string, t long")
    assert sessions(edge, ["k"], "t", 10, [F.count("*").alias("n")]).count() == 2
    with pytest.raises(ValueError):
        sessions(edge, ["k"], "t", 10, [], "arrival")


def test_window_sums(spark):
    rows = [("user_1", 10.0, 5.0), ("user_1", 5.0, 8.0), ("user_1", 20.0, 15.0), ("user_2", 100.0, 6.0)]
    df = spark.createDataFrame(rows, "key string, amount double, at double")
    got = window_aggregate(df, ["key"], seconds_to_millis(F.col("at")), Tumbling(10000), F.sum("amount").alias("total"))
    assert {(x.key, x.start_ms): x.total for x in got.collect()} == {("user_1", 0): 15.0, ("user_1", 10000): 20.0, ("user_2", 0): 100.0}


def test_fold_in_order(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 1, "z")], "key string, seq long, v string")
    got = ordered_fold(df, ["key"], ["seq"], ["v"], F.lit(""), lambda s, r: F.concat(s, r["v"]))
    assert {x.key: x.state for x in got.collect()} == {"k": "ab", "j": "z"}
    other = python_fold(df, ["key"], ["seq"], lambda s, r: (s[0] + r.v, s[1] + 1), ("", 0), "state string, n long")
    assert {x.key: (x.state, x.n) for x in other.collect()} == {"k": ("ab", 2), "j": ("z", 1)}


def test_sliding_join_gives_a_pair_per_shared_window(spark):
    left = spark.createDataFrame([("k", 12000, 1)], "k string, ms long, v int")
    right = spark.createDataFrame([("k", 13000, 2), ("k", 16000, 3), ("j", 12000, 4)], "k string, ms long, v int")
    got = windowed_join(left, right, ["k"], "ms", "ms", Sliding(10000, 5000)).select("start_ms", "right.v").collect()
    assert sorted(map(tuple, got)) == [(5000, 2), (10000, 2), (10000, 3)]
    assert windowed_join(left, right, ["k"], "ms", "ms", Session(1000)).count() == 0


def test_watermark_of_empty_table(spark):
    df = spark.createDataFrame([], "i long, ms long")
    assert with_watermark(df, "ms", ["i"], 5).count() == 0

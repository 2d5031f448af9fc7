import math
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import stream_queries
from tidemark.streaming.stateful import keyed_fold


def batches(stream, tmp_path, order):
    out = []
    see = lambda b, i: out.append([tuple(r) for r in b.collect()])
    stream.select(order, F.input_file_name()).writeStream.foreachBatch(see).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return [(sorted(v for v, _ in b), len({f for _, f in b})) for b in out]


@pytest.mark.parametrize("at", ["id", "if(id < 90, id, id + 10000)", "id div 50 * 50"], ids=["even", "empty chunk", "ties"])
def test_chunks_of_many_files_are_a_batch_each(spark, tmp_path, monkeypatch, at):
    """A chunk beyond a file's rows is written by several tasks, and still is one micro-batch, whatever the other chunks have."""
    monkeypatch.setattr(stream_queries, "CHUNK_FILE_ROWS", 10)
    rows = spark.range(0, 100, 1, 3).select("id", F.expr(at).alias("at"))
    got = batches(stream_queries.as_stream(spark, rows, "at", "chunks"), tmp_path, "at")
    values = sorted(r["at"] for r in rows.collect())
    step = (values[-1] - values[0]) // 3 + 1
    assert [b for b, _ in got] == [[v for v in values if (v - values[0]) // step == i] for i in range(3)]
    assert all(n > 1 for b, n in got if b)


def test_a_fold_asks_little_of_pandas_for_each_key(spark, monkeypatch):
    """With few rows a key, frames cost more than rows: no class, sorted copy or inference for each key."""
    rows = spark.createDataFrame([], "k long, seq long, v string")
    taken = []
    grouped = SimpleNamespace(applyInPandasWithState=lambda run, *rest: taken.append(run))
    stream = SimpleNamespace(sparkSession=spark, columns=rows.columns, schema=rows.schema, groupBy=lambda key: grouped)

    def never(*args, **kwargs):
        raise AssertionError("for each key")

    keyed_fold(stream, "k", "seq", "text string, n long", ("", 0), lambda s, r: (s[0] + (r.v or "-"), s[1] + r.seq))
    state = SimpleNamespace(hasTimedOut=False, exists=False, update=lambda value: None)
    parts = [pd.DataFrame({"k": [1, 1], "seq": [5, 2], "v": ["e", None]}), pd.DataFrame({"k": [1], "seq": [3], "v": ["c"]})]
    monkeypatch.setattr(pd.DataFrame, "itertuples", never)
    monkeypatch.setattr(pd.DataFrame, "sort_values", never)
    assert [f.values.tolist() for f in taken[0]((1,), iter(parts), state)] == [[[1, "-ce", 10]]]


def test_a_fold_orders_numbers_texts_and_nulls(spark, tmp_path):
    """Rows of a key in order, missing ones last, ties as they came; states of other kinds than plain ones come out as they are."""
    rows = spark.createDataFrame([(1, 2.0, "b"), (1, None, "z"), (1, 1.0, "a"), (2, None, "y")], "k long, at double, v string")
    for i, (order, want) in enumerate((("at", {1: "abz", 2: "y"}), ("v", {1: "abz", 2: "y"}))):
        path, got = str(tmp_path / f"in{i}"), {}
        rows.coalesce(1).write.parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        folded = keyed_fold(stream, "k", order, "text string, n double, last timestamp", ("", 0.0, None), lambda s, r: (s[0] + r.v, math.nan if r.at != r.at else r.at, pd.Timestamp(2024, 1, 2)))
        folded.writeStream.foreachBatch(lambda b, _: got.update({r.k: (r.text, r.last.day) for r in b.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / f"ck{i}")).trigger(availableNow=True).start().awaitTermination()  # noqa: B023
        assert got == {k: (t, 2) for k, t in want.items()}

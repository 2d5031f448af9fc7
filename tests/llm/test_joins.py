"""Beyond the size that may be broadcast, the same operators give the same results by merged joins."""

import random

import pytest

from tidemark.llm import common, mixing, pii, simhash, warc


@pytest.fixture(params=[500_000, 0], ids=["broadcast", "merge"])
def limit(request, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", request.param)
    return request.param


def corpus(spark):
    r = random.Random(6)
    base = [" ".join(r.choices("alpha beta gamma delta".split(), k=40)) for _ in range(10)]
    texts = [b + r.choice(["", " x"]) for b in base for _ in range(6)] + [f"write to me u{i}@mail.example.org now" for i in range(8)] + ["write to me ZX-1199-2288 now", None]
    return spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)


def test_same_results_either_way(spark, limit, tmp_path):
    docs = corpus(spark)
    plan = docs.join(common.sized(common.materialize(docs.select("doc_id"), "t")), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (limit > 0) and ("SortMergeJoin" in plan) == (limit == 0)
    near = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert len(near) == docs.count() and len({c for _, _, c in near}) < 40
    assert len(simhash.keep_one(docs).collect()) == len({c for _, _, c in near})
    ids = [tuple(x) for r in pii.spans_of(docs).collect() for x in r["__tm_spans"] if x.kind == "id"]
    assert ids == [("id", 12, 24)]
    taken = {r.doc_id: r.taken for r in mixing.take(docs).collect()}
    assert len(taken) == docs.count()
    pages = spark.createDataFrame([(i, "u", "same" if i % 2 else None) for i in range(20)] + [(99, None, "own")], "page_id long, url string, html string").repartition(3)
    out = f"file://{tmp_path}/warc"
    rows = {r.page_id: r for r in warc.read_archives(warc.deduplicate(pages, out), f"{out}/deduplicated").collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items()} == {i: (("response", None) if i in (0, 1, 99) else ("revisit", i % 2)) for i in [*range(20), 99]}

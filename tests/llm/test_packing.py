import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing


def brute_bins(lengths, capacity):
    """Fewest bins, by search."""
    best = [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i]:
                put(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1 :])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_bound_and_packing_against_search():
    r = random.Random(5)
    for _ in range(60):
        lengths = np.array(sorted((r.randint(1, 20) for _ in range(r.randint(1, 8))), reverse=True))
        bins, offsets, n = packing.best_fit_decreasing(lengths, 20)
        least = brute_bins(lengths.tolist(), 20)
        assert packing.lower_bound(lengths, 20) <= least <= n <= least + 1
        for b in range(n):
            inside = sorted(zip(offsets[bins == b], lengths[bins == b], strict=True))
            assert [o for o, _ in inside] == [0, *itertools.accumulate(x for _, x in inside)][:-1]
            assert sum(x for _, x in inside) <= 20
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3
    assert packing.lower_bound(np.array([7] * 8), 20) == 4
    assert packing.lower_bound(np.full(100, 3), 10) == 34


def certificates(rows, capacity):
    """Each partition's number of bins is what it has, and no less than the bound that comes with it; that one is no more than any bound of its pieces allows."""
    parts = {}
    for x in rows:
        parts.setdefault(x.partition, []).append(x)
    for own in parts.values():
        bins, bound = {x.bins for x in own}, {x.bound for x in own}
        assert bins == {len({x.sequence_id for x in own})} and len(bound) == 1 and bound <= {*range(1 + min(bins))}
        volume = -(-sum(x.length for x in own) // capacity)
        assert min(bins) >= max(min(bound), volume)
        if len(own) < 9:
            assert min(bound) <= brute_bins([x.length for x in own], capacity)
    return parts


@pytest.mark.parametrize("seed", range(2))
def test_exchange_between_partitions(spark, seed):
    """Small partitions leave gaps; rounds save bins, and certificates stay true."""
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 20), r.randint(7, 12)]) for _ in range(400)]
    pieces = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(packing.materialize(pieces, "t"), 20, per_partition=40).collect()
    assert sorted(x.uid for x in rows) == list(range(400))
    fill = {}
    for x in rows:
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for inside in fill.values():
        inside.sort()
        assert [o for o, _ in inside] == [0, *itertools.accumulate(n for _, n in inside)][:-1] and sum(n for _, n in inside) <= 20
    certificates(rows, 20)
    alone = sum(packing.best_fit_decreasing(np.array(lengths[i : i + 40]), 20)[2] for i in range(0, 400, 40))
    bound = packing.lower_bound(np.array(lengths), 20)
    assert bound <= len(fill) < alone


def test_rounds_join_partitions_not_pieces(spark, monkeypatch):
    """No table of pieces that a round writes comes from a join, so rounds don't multiply the rows that joins make."""
    r, plans, write = random.Random(4), {}, packing.materialize

    def watched(df, name, **options):
        if "uid" in df.columns:
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, **options)

    pieces = spark.createDataFrame([(i, i, 0, 0, r.randint(3, 9), 0) for i in range(600)], packing.PIECES)
    pieces = write(pieces, "t")
    monkeypatch.setattr(packing, "materialize", watched)
    rows = packing.pack(pieces, 20, per_partition=20).collect()
    assert any(name.startswith("packed-all") for name in plans) and not any("Join" in plan for plan in plans.values())
    bins = {}
    for x in rows:
        bins.setdefault(x.partition, set()).add(x.sequence_id)
    assert len(rows) == 600 and all(len(bins[x.partition]) == x.bins >= x.bound for x in rows)


def test_ids_equal_those_of_the_tokenizer():
    exact = Tokenizer.from_file(packing.TOKENIZER)
    texts = ["", "Hello  world's\n\n x1234", "é" * 50 + " ß  x", "日本語 emoji 😀", "<|endoftext|> a", " " * 3000 + "b", "a" * 5000, "'S don't \t\r\n  end ", "́x​ y　z", "“quoted” — …"]
    encode = packing.encoder()
    for t in texts:
        assert encode(t) == exact.encode(t, add_special_tokens=False).ids


def test_pieces_and_sequences(spark):
    exact = Tokenizer.from_file(packing.TOKENIZER)
    r = random.Random(2)
    texts = [None, "", "one", "word " * 2047, "word " * 2048, "long text " * 9000, *(" ".join(r.choices(["alpha", "beta", "été", "x9"], k=r.randint(1, 1500))) for _ in range(120)), *["copy of this"] * 300]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    docs = docs.unionByName(docs.where("doc_id = 2"))
    pieces = packing.materialize(packing.tokenize(docs), "t")
    rows = packing.pack(pieces, per_partition=60).collect()
    assert len(rows) == pieces.count()
    seen = {}
    for x in rows:
        seen.setdefault(x.sequence_id, []).append((x.offset, x.length))
        if x.doc_id != 2:
            ids = np.array([*exact.encode(texts[x.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
            assert x.length == 2048 or x.piece == 0
    for inside in seen.values():
        inside.sort()
        assert [o for o, _ in inside] == [0, *itertools.accumulate(n for _, n in inside)][:-1] and sum(n for _, n in inside) <= 2048
    bound = packing.lower_bound(np.array([x.length for x in rows]))
    assert bound <= len(seen) <= bound + 3
    certificates(rows, 2048)
    assert packing.pack_documents(docs.limit(0)).count() == 0

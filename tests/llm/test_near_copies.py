import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, near_copies


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """texts: id -> text; every pair is compared."""
    sets, root = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in texts}


def make():
    r, texts = random.Random(5), [None, "", "One", "one", "two words", "a B c d e", "a b c d e f"]
    for n, copies, most in [(60, 12, 3), (200, 40, 9), (400, 12, 20), (30, 30, 2)] * 2:
        base = [f"w{r.randrange(5000)}" for _ in range(n)]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randint(0, most)):
                words[r.randrange(n)] = f"x{r.randrange(5000)}"
            texts.append(" ".join(words))
    return {1000 - i: t for i, t in enumerate(texts)}


def test_stage_against_all_pairs(spark):
    """Near copies that lie beyond two bits of a 3-word SimHash are found; pairs below 0.8 are not."""
    texts = make()
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, __x string")
    docs = docs.unionByName(docs.where("doc_id = 900"))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(brute_groups(texts).values()))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_filters_lose_no_similar_pair():
    """Every pair of similar sets shares a key where the positional filter lets it pass, whatever the order of buckets."""
    r = random.Random(9)
    texts = {i: t for i, t in make().items() if r.random() < 0.5}
    sets = {i: near_copies.shingles((t or "").lower().encode()) for i, t in texts.items()}
    for seed in range(3):
        counts = np.random.default_rng(seed).integers(0, 50, near_copies.BUCKETS)
        keys = {i: near_copies.prefix(x, counts).tolist() for i, x in sets.items()}
        for i, x in sets.items():
            for j, y in sets.items():
                both = len(np.intersect1d(x, y))
                if i < j and len(x) and 5 * both >= 4 * (len(x) + len(y) - both):
                    need = math.ceil(0.8 / 1.8 * (len(x) + len(y)) - 1e-6)
                    passes = [k for k in set(keys[i]) & set(keys[j]) if min(len(x) - keys[i].index(k), len(y) - keys[j].index(k)) >= need]
                    short, n = (keys[i], len(x)) if len(x) <= len(y) else (keys[j], len(y))
                    assert any(n - short.index(k) >= math.ceil(0.8 / 1.8 * 2 * n - 1e-6) for k in passes)


def test_every_key_is_compared_to_the_end(spark):
    """Chains that no head of a key connects: links among the others are found by the last round."""
    r, texts = random.Random(2), {}
    for c in range(6):
        base = [f"c{c}w{i}" for i in range(120)]
        texts[100 * c] = " ".join(base)
        for k in range(1, 12):  # every third one is a copy of the one before, the others of the first
            words = (texts[100 * c + k - 1] if k % 3 == 0 else texts[100 * c]).split()
            for _ in range(r.randint(1, 3)):
                words[r.randrange(120)] = f"x{r.randrange(10**6)}"
            texts[100 * c + k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = sorted(x.doc_id for x in near_copies.keep_one(docs).collect())
    assert kept == sorted(set(brute_groups(texts).values())) and 6 <= len(kept) < len(texts)


def test_keys_are_in_order_of_exact_counts(spark, monkeypatch):
    """Keys are the rarest shingles by their own counts in the whole corpus, over many ranges and blocks."""
    monkeypatch.setattr(near_copies, "RANGE", 200)
    texts = {i: t for i, t in enumerate(dict.fromkeys((t or "").lower() for t in make().values())) if t}
    sets = {i: near_copies.shingles(t.encode()) for i, t in texts.items()}
    found = Counter(h for x in sets.values() for h in x.tolist())
    rows = spark.createDataFrame([(i * 300, t.encode(), len(sets[i])) for i, t in texts.items()], "uid long, text binary, n int")
    keys = near_copies.keys(rows.select("uid", F.col("n").cast("long")), rows.select("uid", "text")).collect()
    expected = set()
    for i, x in sets.items():
        order = sorted(x.tolist(), key=lambda h: (found[h], h))
        most = len(order) - math.ceil(0.8 * len(order) - 1e-6) + 1
        expected |= {(i * 300, len(order), at, h >> 16) for at, h in enumerate(order[:most]) if found[h] > 1}
    assert len(keys) == len(expected) > 100 and {tuple(k) for k in keys} == expected


def test_packed_numbers_come_back():
    for values in ([], [0], [255, 256, 0], [1 << 47, 3, 3]):
        assert near_copies.unpack(near_copies.pack(np.array(values, np.int64))).tolist() == values


def test_texts_go_through_no_shuffle(spark, monkeypatch):
    """However many documents stay, they are chosen by a broadcast bitmap."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(i, f"w{i % 40} two", "c") for i in range(60)], "doc_id long, text string, __x string")
    kept = near_copies.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(x.doc_id for x in kept.collect()) == list(range(40))
    rows = spark.range(0, 300_000, 7).select(F.col("id").alias("uid"), F.lit("x").alias("text"))
    wanted = spark.range(0, 300_000, 5).unionByName(spark.createDataFrame([(1 << 40,)], "id long"))
    assert sorted(x.uid for x in near_copies.chosen(rows, wanted).collect()) == list(range(0, 300_000, 35))

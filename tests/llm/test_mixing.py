import hashlib
import itertools
import math
import random

import pytest

from tidemark.llm import mixing


def waterfill(sizes, weights, share=1.5, most=2.0):
    total, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        if not free:
            return [most * s for s in sizes]
        level = left / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > most * sizes[i]}
        if not over:
            return [most * s if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_loop(spark, seed):
    r = random.Random(seed)
    names = sorted({r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(9)})
    sizes = [r.choice([0, 1, 5, 100, 10000]) for _ in names]
    got = mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).orderBy("source").collect()
    want = waterfill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert [x.target for x in got] == pytest.approx(want)


def brute_taken(rows, targets):
    """rows: (id, source, size); documents of weight 1 in order of keys."""
    out = {}
    for source, target in targets.items():
        own = [(i, s) for i, src, s in rows if src == source]
        total = sum(s for _, s in own)
        epochs = int(target // total) if total else 0
        rest = math.floor(target - epochs * total + 0.5)
        key = lambda x: -math.log((int(hashlib.md5(str(x[0]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
        for i, s in sorted(own, key=key):
            out[i] = epochs * s + max(0, min(s, rest))
            rest -= s
    return out


def test_taken_against_brute_force_and_mix(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([0, 1, 3, 40, 200])) for i in range(500)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n) if n else None, s, 1, "x") for i, s, n in rows], "doc_id long, text string, source string, n_chars long, size string")
    got = {x.doc_id: x for x in mixing.take(docs).collect()}
    names = ["a", "b", "hot", None]
    totals = {s: sum(n for _, src, n in rows if src == s) for s in names}
    want = dict(zip(names, waterfill([totals[s] for s in names], [3, 1, 2, 3]), strict=True))
    taken = brute_taken(rows, want)
    assert len(got) == 500
    for i, s, n in rows:
        assert (got[i].size, got[i].source_size) == (n, totals[s]) and got[i].target == pytest.approx(want[s])
        assert got[i].taken == taken[i] <= 2 * n
    for s in names:
        assert abs(sum(got[i].taken for i, src, _ in rows if src == s) - want[s]) <= 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    seen = {}
    for x in mixed.collect():
        seen[x.doc_id] = seen.get(x.doc_id, 0) + len(x.text.split())
        assert x.n_chars == len(x.text)
    assert seen == {i: t for i, t in taken.items() if t}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "a", "x"), (3, "w " * 200000, "a", "x"), (3, "w " * 200000, "a", "x"), (None, "one two", None, "x")], "doc_id long, text string, source string, target string")
    got = mixing.take(docs).collect()
    assert len(got) == 5 and all(x.taken <= 2 * x.size for x in got)
    again = sorted(map(tuple, mixing.take(docs.repartition(3)).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)
    assert mixing.take(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.take(docs.where("size(split(text, ' ')) < 2")).where("taken > 0").count() == 0


def test_cut_is_bounded_whatever_the_weights(spark):
    """Sources of low weights, of one id, and of rows all alike: no more rows are sorted than ``held``, and the cut is that of a plain sort."""
    rows = [(i, "#" * 30 + f" w{i % 5}" * (1 + i % 3), "low") for i in range(3000)] + [(None, f"text {i}", "same id") for i in range(3000)] + [(7, "equal rows", "alike")] * 3000
    rows += [(i, "plain words", "even") for i in range(10, 3010)] + [(1, "one", "tiny"), (2, "two words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    made = mixing.materialize(docs.select(*mixing.sizes(docs, "doc_id", "text", "source")), "t")
    goals = made.groupBy("source").agg((mixing.F.sum("size") * 0.8).cast("long").alias("rest"))
    at = mixing.narrowed(made, goals, held=16)
    left = made.where("size > 0").join(at, mixing.F.col("source").eqNullSafe(mixing.F.col("of")) & mixing.F.col("at").between(mixing.F.col("low"), mixing.F.col("high")))
    sorted_rows = {r.of: (r.n, r.m) for r in left.groupBy("of").agg(mixing.F.count("*").alias("n"), mixing.F.countDistinct("at").alias("m")).collect()}
    assert len(sorted_rows) == 5 and all(n <= 16 or m == 1 for n, m in sorted_rows.values())
    planned = {r.source: r for r in mixing.plan(made, held=16).collect()}
    for source, p in planned.items():
        own = sorted((tuple(r.at), r.size) for r in made.where(mixing.F.col("source").eqNullSafe(mixing.F.lit(source))).collect())
        rest = math.floor(p.target - p.epochs * p.source_size + 0.5)
        if not rest:
            assert p.cut_at is None
            continue
        before = 0
        for at_, group in itertools.groupby(own, key=lambda x: x[0]):
            sizes = [s for _, s in group]
            if before < rest <= before + sum(sizes):
                assert tuple(p.cut_at) == at_ and p.cut_words == (rest - before) // len(sizes)
            before += sum(sizes)


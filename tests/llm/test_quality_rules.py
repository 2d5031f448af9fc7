import math
import random
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as q
from tidemark.llm.common import OWN
from tidemark.llm.textstats import FEATURES, with_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "one", "a\x0bb\x0cc\rd", "é ñ 漢字 😀 $ # |x|", "x " * 30, "a b c d e f g h i a b c d e f g h", "a b c d e f g h a b c d e f g h a b", "same\nsame\n\n \nsame ", "  nbsp em", "w%d " * 20, " ".join(f"w{i % 90}" for i in range(400)), "z" * 100000, "q r s t u v w x y\n" * 9000]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, words string")
    rows = with_counts(docs).select("doc_id", f"{OWN}counts.*").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), r.doc_id


def corpus(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        words = [f"w{(i * 7919 + j * 31) % 9973}" for j in range(30 + i % 40)]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in words) + ".", "keep me"))
        labels.append((i, 0 if bad else 1))
    labels += [(5, 0), (7, None), (None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_rules_and_filter(spark):
    docs, labels = corpus(spark)
    judged, rules = q.judge(docs, labels)
    assert rules and all(r.conditions for r in rules)
    kept = {r.doc_id for r in judged.where(F.col(f"{OWN}rule").isNull()).collect()}
    assert kept == {i for i in range(400) if i % 5}
    left = q.filter_documents(docs.unionByName(docs.where("doc_id = 1")), labels)
    assert left.columns == docs.columns and left.count() == len(kept) + 1


def brute_rules(rows, cuts):
    """The list by plain loops over (bad, aside, values)."""
    rules, rest = [], list(rows)
    holds = lambda c, v: v[c.feature] > c.threshold if c.above else v[c.feature] <= c.threshold
    tried = sum(map(len, cuts.values()))
    least = NormalDist().inv_cdf(1 - q.ALPHA / 4 / tried) ** 2
    while True:
        inside, grown = [r for r in rest if not r[1]], []
        while True:
            best, p0 = None, sum(r[0] for r in inside)
            n0 = len(inside) - p0
            for f in cuts if p0 and n0 else ():
                for t in cuts[f]:
                    for above in (False, True):
                        c = q.Condition(f, above, t)
                        got = [r for r in inside if holds(c, r[2])]
                        p = sum(r[0] for r in got)
                        n = len(got) - p
                        if p < q.COVER or len(got) == len(inside) or p / len(got) <= p0 / len(inside):
                            continue
                        table = np.array([[p, n], [p0 - p, n0 - n]], float)
                        even = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
                        if 2 * (table[table > 0] * np.log(table[table > 0] / even[table > 0])).sum() < least:
                            continue
                        gain = p * (math.log2(p / len(got)) - math.log2(p0 / len(inside)))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, c, got, n)
            if best is None or best[0] <= 1e-9:
                break
            grown.append(best[1])
            inside = best[2]
            if best[3] == 0:
                break
        if not grown:
            return rules
        aside = [[r for r in rest if r[1] and all(holds(c, r[2]) for c in grown[: i + 1])] for i in range(len(grown))]
        worth = [(2 * sum(r[0] for r in x) - len(x)) / max(1, len(x)) for x in aside]
        keep = max(range(len(grown)), key=lambda i: (worth[i], -i))
        p = sum(r[0] for r in aside[keep])
        if p >= q.COVER and p >= q.PRECISION * len(aside[keep]):
            grown = grown[: keep + 1]
            rules.append(" and ".join(map(str, grown)))
        rest = [r for r in rest if not all(holds(c, r[2]) for c in grown)]


def test_list_against_brute_force(spark):
    """Two ways to be bad, one of them of two conditions, some noise, and a tempting group that the rows kept aside refute."""
    r = random.Random(7)
    rows = []
    for i in range(1500):
        v = {f: float(r.randint(0, 30)) for f in FEATURES}
        bad = v["symbol_share"] > 22 or (v["upper_share"] < 8 and v["digit_share"] > 20) or r.random() < 0.02
        aside = i % 3 == 0
        if v["stop_share"] == 17:
            bad = not aside
        rows.append((bad, aside, v))
    frame = spark.createDataFrame([(b, a, *(v[f] for f in FEATURES)) for b, a, v in rows], ["bad", "aside", *FEATURES]).repartition(3)
    got = [str(x) for x in q.learn(frame)]
    assert got == brute_rules(rows, q._thresholds(frame.where("not aside"))) and len(got) >= 2
    noise = spark.createDataFrame([(r.random() < 0.2, a, *(v[f] for f in FEATURES)) for _, a, v in rows], ["bad", "aside", *FEATURES])
    assert q.learn(noise) == []


def test_edges(spark):
    docs, labels = corpus(spark, 40)
    judged, rules = q.judge(docs, labels.limit(0))
    assert rules == [] and judged.where(F.col(f"{OWN}rule").isNull()).count() == 40
    _, one_class = q.judge(docs, labels.where("quality = 1"))
    assert one_class == []
    assert q.judge(docs.limit(0), labels)[0].count() == 0
    odd = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string")
    assert q.filter_documents(odd, labels).count() == sum(brute(t)[0] >= 20 and 100 * brute(t)[4] <= 30 * brute(t)[0] for t in TEXTS)

"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditions.

Base rules fail texts of under ``LEAST_WORDS`` words or with over 30 % of words in repeated 8-word windows. Of what passes,
labelled documents give statistics: each feature is cut at quantiles (of all and of the low-quality ones), and counts by
class and interval, aggregated by Spark over all labelled rows, are what learning sees. A rule grows by the condition of most FOIL
gain, as long as one sets low-quality rows apart significantly (a likelihood-ratio test at ``ALPHA`` for all conditions that were
tried together), is pruned to the prefix that does best on a third of rows kept aside, and is accepted if it is precise there.
Then the rows it covers are set aside, accepted or not, and the next one grows, until no condition is significant: neither the
number of rules nor that of conditions is fixed. The list is emitted as one ``CASE``.

All of this is DataFrame expressions and aggregates: the driver gets a row per feature and interval at each step.

Defined results: a null text is an empty one and fails; without labels (or without both classes) there is no rule and base
rules alone decide; of conditions with equal gain the first feature's first cut is taken; texts of any length count whole; labels repeated for a document count once, the lowest; null labels are left out; repeated rows are
judged each; an empty table gives no rows; other columns stay as they are in ``filter_documents`` and are ignored elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, any_of, materialize, read
from .textstats import FEATURES, features, with_counts

LEAST_WORDS = 20
#: Chance that a condition passes the test where features tell nothing, over all conditions tried for it.
ALPHA = 0.01
#: What an accepted rule needs on the rows kept aside: this share of low-quality rows, and this many of them.
PRECISION = 0.9
COVER = 3
QUANTILES = 40


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class Rule:
    conditions: list[Condition] = field(default_factory=list)

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out &= c.column(values)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def verdict(rules: list[Rule], c: Column) -> Column:
    """The first rule that rejects a text, as a string; null if it is kept."""
    values, out = features(c), F.when(base_failed(c), F.lit("base"))
    for rule in rules:
        out = out.when(rule.column(values), F.lit(str(rule)))
    return out


def labelled(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows (bad, aside, features) of the documents that pass the base rules and have a label."""
    c = F.col(f"{OWN}counts")
    rows = counted.where(~base_failed(c)).select(F.col(id_col).alias("id"), *[v.alias(k) for k, v in features(c).items()])
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    return rows.join(marks, "id").select((F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("aside"), *FEATURES)


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Cuts of each feature: midway between neighbours among the quantiles over all rows and over the low-quality ones."""
    at = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    cuts = rows.agg(*[F.percentile_approx(x, at, F.lit(2000)).alias(f"{name}_{f}") for f in FEATURES for name, x in (("all", F.col(f)), ("bad", F.when(F.col("bad"), F.col(f))))]).first()
    values = {f: sorted({*(cuts[f"all_{f}"] or []), *(cuts[f"bad_{f}"] or [])}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items()}


def learn(rows: DataFrame) -> list[Rule]:
    """The decision list for rows of ``labelled``."""
    rows = materialize(rows, "labelled")
    cuts = _thresholds(rows.where("not aside"))
    if not any(cuts.values()):
        return []
    # A value's interval: how many cuts lie below it, so that value > cuts[k] is interval > k.
    code = lambda f: F.size(F.filter(F.array(*[F.lit(x) for x in cuts[f]]).cast("array<double>"), lambda t: F.col(f) > t)).alias(f)
    coded = materialize(rows.select("bad", "aside", *[code(f) for f in FEATURES]), "coded")
    as_code = lambda c: (F.col(c.feature) > cuts[c.feature].index(c.threshold)) if c.above else (F.col(c.feature) <= cuts[c.feature].index(c.threshold))
    holds = lambda conditions: F.lit(True) if not conditions else _all([as_code(c) for c in conditions])

    rules: list[Rule] = []
    rest, turn = coded, 0
    while True:
        grown: list[Condition] = []
        while (best := _best_condition(rest.where(~F.col("aside") & holds(grown)), cuts)) is not None:
            grown.append(best[0])
            if best[1]:
                break
        if not grown:
            return rules
        tests = [F.sum((holds(grown[: i + 1]) & (F.col("bad") == bad)).cast("long")).alias(f"{name}{i}") for i in range(len(grown)) for name, bad in (("p", True), ("n", False))]
        seen = rest.where("aside").agg(*tests).first()
        got = [(seen[f"p{i}"] or 0, seen[f"n{i}"] or 0) for i in range(len(grown))]
        worth = lambda i: (got[i][0] - got[i][1]) / max(1, sum(got[i]))
        keep = max(range(len(grown)), key=lambda i: (worth(i), -i))
        if got[keep][0] >= COVER and got[keep][0] >= PRECISION * sum(got[keep]):
            rules.append(Rule(grown[: keep + 1]))
            grown = grown[: keep + 1]
        rest, turn = rest.where(~holds(grown)), turn + 1
        if turn % 16 == 0:
            rest = materialize(rest, f"coded-{turn}")


def _all(conditions: list[Column]) -> Column:
    return ~any_of([~c for c in conditions])


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, bool] | None:
    """The condition of most FOIL gain among those that are significant, and whether it leaves low-quality rows alone; None if there is none."""
    cells = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("code")) for f in FEATURES])).alias("x"))
    counts: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
    for r in cells.groupBy("x.f", "x.code").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect():
        counts[r["f"]][r["code"]] = [r["p"], r["n"]]
    p0, n0 = (sum(x[i] for x in counts[FEATURES[0]].values()) for i in (0, 1))
    if not p0 or not n0:
        return None
    best, least = None, NormalDist().inv_cdf(1 - ALPHA / 4 / max(1, sum(map(len, cuts.values())))) ** 2
    for f in FEATURES:
        below = [0, 0]
        for k, cut in enumerate(cuts[f]):
            below = [b + x for b, x in zip(below, counts[f].get(k, (0, 0)), strict=True)]
            for above, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                if p < COVER or p + n == p0 + n0:
                    continue
                if p * (p0 + n0) <= p0 * (p + n) or _ratio(p, n, p0, n0) < least:
                    continue
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, Condition(f, above, cut), n == 0)
    return best[1:] if best and best[0] > 1e-9 else None


def _ratio(p: int, n: int, p0: int, n0: int) -> float:
    """The likelihood-ratio statistic of a split: how far the covered rows and the others are from the shares of all."""
    cells = [(p, p + n, p0), (n, p + n, n0), (p0 - p, p0 + n0 - p - n, p0), (n0 - n, p0 + n0 - p - n, n0)]
    return 2 * sum(x * math.log(x * (p0 + n0) / (rows * total)) for x, rows, total in cells if x)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """(id, counts struct, rule that rejects it) of every document, and the rules learned."""
    counted = materialize(with_counts(docs.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, f"{OWN}counts"), "counts")
    rules = learn(labelled(counted, labels, id_col))
    return counted.withColumn(f"{OWN}rule", verdict(rules, F.col(f"{OWN}counts"))), rules


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns. Counts are made twice, for learning and for the filter, rather
    than writing the texts beside them or joining the verdicts back to the texts."""
    names = docs.columns
    counted = with_counts(docs, text_col)
    rules = learn(labelled(materialize(counted.select(id_col, f"{OWN}counts"), "counts"), labels, id_col))
    return counted.where(verdict(rules, F.col(f"{OWN}counts")).isNull()).select(*[F.col(f"`{c}`") for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    c = F.col(f"{OWN}counts")
    return judged.select(
        "doc_id", *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(c).alias("base_failed"), F.col(f"{OWN}rule").isNull().alias("kept"), F.col(f"{OWN}rule").alias("rule"),
    )

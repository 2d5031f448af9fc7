"""Quality scores from preference pairs: a Bradley-Terry model on feature differences.

Of a bounded sample of labelled documents (``MAX_ROWS`` a class), pairs of one document marked good and one marked bad are
drawn; the model says that the good one is preferred with the logistic of the difference of their scores, a score being
linear in the features of ``basis``. It is fitted in numpy by logistic loss with a small ridge. The cut is a quantile of the
sample's scores: of the levels tried, the one that tells the classes apart best. A score is the logistic of the distance from
the cut, shifted so that ``CUT`` marks it, so it is between 0 and 1 and needs no second parameter.

Scoring is a Spark expression over whole texts. The labels, the language, the source and the id never enter it.

Defined results: a null text is an empty one and is scored too; without labels of both classes every score is 0.5; null
labels are left out, repeated ones count once, the lowest; texts of any length count whole; of rows that tie for a place in the
sample the smaller id, then the smaller features, is taken; of levels that tell the classes apart equally well the lowest is the
cut; repeated rows score equally; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, fold, materialize, read, uniform
from .textstats import FEATURES, features, with_counts

#: Labelled documents of a class that the model is fitted on at most, and pairs drawn from them.
MAX_ROWS = 6000
PAIRS = 40_000
CUT = 0.3
KNOTS = (0.02, 0.1, 0.5, 0.9, 0.98)
RIDGE = 1e-3


@dataclass
class Model:
    knots: list[tuple[str, float, float]]  # feature, knot, scale: the basis is the part above the knot, in units of the scale, 1 at most
    weights: list[float]
    cut: float

    def raw(self, values: dict[str, Column]) -> Column:
        out = F.lit(0.0)
        for (name, knot, scale), w in zip(self.knots, self.weights, strict=True):
            out += F.lit(float(w)) * F.least(F.greatest((values[name] - knot) / scale, F.lit(0.0)), F.lit(1.0))
        return out

    def score(self, values: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-(self.raw(values) - self.cut + math.log(CUT / (1 - CUT)))))


def basis(x: np.ndarray, bad: np.ndarray) -> list[tuple[str, float, float]]:
    """Pieces of each feature between neighbouring quantiles of both classes."""
    out = []
    for i, name in enumerate(FEATURES):
        at = np.unique(np.concatenate([np.quantile(x[rows, i], KNOTS) for rows in (bad, ~bad)] + [[x[:, i].max()]]))
        out += [(name, float(a), float(b - a)) for a, b in zip(at, at[1:], strict=False) if b - a > 1e-9]
    return out


def design(x: np.ndarray, knots: list[tuple[str, float, float]]) -> np.ndarray:
    return np.stack([np.clip((x[:, FEATURES.index(name)] - knot) / scale, 0, 1) for name, knot, scale in knots], axis=1) if knots else np.zeros((len(x), 0))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = 25, seed: int = 3) -> Model | None:
    """Logistic regression on differences of random (good, bad) pairs, by Newton steps."""
    if good.all() or not good.any():
        return None
    knots = basis(x, ~good)
    z = design(x, knots)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    w, ridge = np.zeros(d.shape[1]), RIDGE * np.eye(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + RIDGE * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = z @ w
    levels = np.unique(np.clip(np.concatenate(([(~good).mean()], np.linspace(0.02, 0.6, 59))), 0, 1))
    cuts = np.quantile(scores, levels)
    told = [(scores[good] >= c).mean() + (scores[~good] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(told) >= max(told) - 1e-12)
    return Model(knots, w.tolist(), float(np.mean([cuts[best[0]], _below(scores, cuts[best[0]])])))


def _below(scores: np.ndarray, cut: float) -> float:
    """The score next below the cut, so that the cut can lie between two scores that occur."""
    under = scores[scores < cut]
    return float(under.max()) if len(under) else cut


def train(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on the rows of ``counted`` (those that may be learned from) that have a label."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    rows = counted.select(F.col(id_col).alias("id"), *[v.alias(k) for k, v in features(F.col(f"{OWN}counts")).items()]).join(marks, "id")
    rows = materialize(rows.select((F.col("label") != 0).alias("good"), *FEATURES, uniform("id", seed=5).alias("order"), "id"), "labelled")
    got = []
    for r in rows.groupBy("good").count().orderBy("good").collect():
        # The share that is sure to hold enough rows goes on to the sort, so that the driver gets about that many, whatever the number of tasks.
        share = rows.where((F.col("good") == r["good"]) & (F.col("order") < min(1.0, 1.2 * max_rows / r["count"] + 1e-3)))
        got += share.orderBy("order", "id", *FEATURES).limit(max_rows).collect()
    return fit(np.array([[r[f] for f in FEATURES] for r in got]), np.array([r["good"] for r in got])) if got else None


def score(counted: DataFrame, model: Model | None) -> Column:
    return model.score(features(F.col(f"{OWN}counts"))) if model else F.lit(0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = materialize(with_counts(docs).select("doc_id", f"{OWN}counts"), "counts")
    model = train(counted.where(fold(F.col("doc_id"), 5) != 0), read(spark, sf_dir, "labels"))
    scored = counted.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(counted, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))

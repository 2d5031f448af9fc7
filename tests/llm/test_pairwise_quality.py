import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pairwise_quality as q
from tidemark.llm.common import OWN, fold
from tidemark.llm.textstats import FEATURES, features, with_counts


def test_fit_recovers_a_preference():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(FEATURES)))
    good = x[:, 0] - x[:, 3] > 0
    model = q.fit(x, good)
    raw = q.design(x, model.knots) @ np.array(model.weights)
    assert ((raw >= model.cut) == good).mean() > 0.97


def test_spark_score_equals_numpy(spark):
    docs = spark.createDataFrame([(i, " ".join(["word###" if i % 3 == 0 else f"Word{j}" for j in range(5 + i)])) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    counted = with_counts(docs)
    model = q.train(counted.where(fold(F.col("doc_id"), 5) != 0), labels)
    rows = counted.select("doc_id", q.score(counted, model).alias("score"), *[v.alias(k) for k, v in features(F.col(f"{OWN}counts")).items()]).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    raw = q.design(x, model.knots) @ np.array(model.weights) - model.cut + np.log(0.3 / 0.7)
    assert [r.score for r in rows] == pytest.approx((1 / (1 + np.exp(-raw))).tolist(), abs=1e-9)
    assert all((r.score >= 0.3) == (r.doc_id % 3 != 0) for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "x " * 100000, 1.0), (3, "x " * 100000, 1.0), (None, "a b", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, None)], "doc_id long, quality int")
    counted = with_counts(docs)
    assert q.train(counted, labels) is None and q.train(counted, labels.limit(0)) is None
    assert [r[0] for r in counted.select(q.score(counted, None)).collect()] == [0.5] * 5
    assert with_counts(docs.limit(0)).count() == 0
    both = spark.createDataFrame([(3, 1), (2, 0)], "doc_id long, quality int")
    scores = [r[0] for r in counted.select(q.score(counted, q.train(counted, both))).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[2] == scores[3]


def test_fit_against_plain_descent():
    """The weights are those that plain gradient descent on the logistic loss of the pairs comes to; the cut is the best of all levels tried."""
    rng = np.random.default_rng(1)
    x = rng.random((300, len(FEATURES)))
    good = x[:, 1] + 0.3 * rng.random(300) > 0.6
    model = q.fit(x, good, pairs=2000)
    z = np.array([[min(max((row[FEATURES.index(name)] - knot) / scale, 0.0), 1.0) for name, knot, scale in model.knots] for row in x])
    draw = np.random.default_rng(3)
    better, worse = draw.choice(np.flatnonzero(good), 2000), draw.choice(np.flatnonzero(~good), 2000)
    w = np.zeros(z.shape[1])
    for _ in range(60_000):
        margin = (z[better] - z[worse]) @ w
        w -= 0.5 * (-((1 / (1 + np.exp(margin)))[:, None] * (z[better] - z[worse])).mean(axis=0) + q.RIDGE * w)
    assert np.abs(z @ w - z @ np.array(model.weights)).max() < 0.05
    scores = z @ np.array(model.weights)
    told = lambda c: (scores[good] >= c).mean() + (scores[~good] < c).mean()
    levels = [(~good).mean(), *np.linspace(0.02, 0.6, 59)]
    assert told(model.cut) >= max(told(np.quantile(scores, level)) for level in levels) - 1e-9

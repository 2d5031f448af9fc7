import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import byte_cnn
from tidemark.llm.common import fold

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["eau", "oi", "é", "que"]}


def make(n, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(r.choices(SYLLABLES[lang], k=3)) for _ in range(r.randint(3, 300))), lang))
    return rows


def test_tables_equal_convolution():
    rng = np.random.default_rng(0)
    shape = {w: rng.normal(size=(w, byte_cnn.EMBEDDED, byte_cnn.FILTERS)).astype(np.float32) for w in byte_cnn.WIDTHS}
    n_all = byte_cnn.FILTERS * len(byte_cnn.WIDTHS)
    net = byte_cnn.Net(["x", "y"], rng.normal(size=(256, byte_cnn.EMBEDDED)).astype(np.float32), shape, rng.normal(size=n_all).astype(np.float32), rng.normal(size=(n_all, 2)).astype(np.float32), np.zeros(2, np.float32))
    grid, owner, weight = byte_cnn.windows([b"hello w\xc3\xb6rld " * 40, b"", b"q" * 256])
    got = byte_cnn.log_probabilities(net, byte_cnn.tables(net), grid)
    for row, x in zip(got, grid, strict=True):
        hidden = []
        for i, w in enumerate(byte_cnn.WIDTHS):
            for f in range(byte_cnn.FILTERS):
                hidden.append(max(0, max(sum(float(net.embed[x[t + j]] @ shape[w][j][:, f]) for j in range(w)) + net.bias[i * byte_cnn.FILTERS + f] for t in range(byte_cnn.WINDOW))))
        logits = np.array(hidden) @ net.dense
        assert np.allclose(row, logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max(), atol=1e-2)
    assert owner.tolist() == [0, 0, 0, 1, 2] and weight[3] == 1 / 256


def test_held_out_accuracy_and_edges(spark):
    docs = spark.createDataFrame(make(600), "doc_id long, text string, lang string")
    net = byte_cnn.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: r for r in byte_cnn.predict(docs, net).collect()}
    held = [(i, lang) for i, _, lang in make(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum(got[i].lang_pred == lang for i, lang in held) > 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "12 34 !! ² Ⅷ _", "z"), (4, "schein " * 200000, "z"), (5, "KALO MITU", "z"), (5, "KALO MITU", "z")], "doc_id long, text string, score string")
    seen = sorted(byte_cnn.predict(odd, net).collect())
    assert [r.lang_pred for r in seen] == ["und", "und", "und", "bb", "aa", "aa"] and seen[0].score == 0.0
    assert all(0 <= r.score <= 1 for r in seen)
    assert byte_cnn.train(docs.limit(0)) is None
    assert {r.lang_pred for r in byte_cnn.predict(odd, None).collect()} == {"und"}
    again = {r.doc_id: r.score for r in byte_cnn.predict(docs.repartition(3), byte_cnn.train(docs.where(fold(F.col("doc_id"), 4) != 2).repartition(5))).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in again)


def test_sample_keeps_small_languages(spark):
    """Many big languages don't push small ones out of the bounded sample."""
    sizes = {f"big{i:02}": 3000 for i in range(20)} | {"small": 60, "tiny": 5}
    docs = spark.createDataFrame([(lang, n) for lang, n in sizes.items()], "lang string, n int").select(F.explode(F.sequence(F.lit(1), "n")).alias("i"), "lang")
    docs = docs.select(F.xxhash64("lang", "i").alias("doc_id"), F.concat("lang", F.lit(" text "), F.col("i").cast("string")).alias("text"), "lang")
    seen = {r["lang"]: r["count"] for r in byte_cnn.sample(docs, per_lang=120, max_rows=1200).groupBy("lang").count().collect()}
    assert seen["small"] > 40 and seen["tiny"] == 5 and len(seen) == 22 and min(seen.values()) >= 5 and sum(seen.values()) < 1400
    many = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), (F.col("id") % 600).cast("string").alias("lang"))
    assert byte_cnn.sample(many).select("lang").distinct().count() == 600
    assert byte_cnn.level([10] * 4 + [10**6] * 6) == byte_cnn.PER_LANG and byte_cnn.level([10**6] * 1000) == byte_cnn.LEAST


def test_pooling_over_windows_against_single_windows(spark):
    """A text's log-probabilities are the means of those of its windows, each taken as a text of its own, weighted by bytes."""
    docs = spark.createDataFrame(make(300), "doc_id long, text string, lang string")
    net = byte_cnn.train(docs)
    made = byte_cnn.tables(net)
    r = random.Random(5)
    texts = [" ".join("".join(r.choices(SYLLABLES[r.choice(list(SYLLABLES))], k=3)) for _ in range(n)) for n in (3, 40, 90, 400)]
    got = {x.doc_id: x for x in byte_cnn.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, text in enumerate(texts):
        data = byte_cnn.to_bytes(text)
        total, weights = np.zeros(len(net.langs)), 0.0
        for at in range(0, len(data), byte_cnn.WINDOW):
            # A window sees the three bytes after it, so that no filter stops at its edge.
            row = np.frombuffer(data[at : at + byte_cnn.WINDOW + 3].ljust(byte_cnn.WINDOW + 3, b"\0"), np.uint8)[None]
            weight = min(byte_cnn.WINDOW, len(data) - at) / byte_cnn.WINDOW
            total, weights = total + byte_cnn.log_probabilities(net, made, row)[0] * weight, weights + weight
        soft = np.exp(total / weights - (total / weights).max())
        assert got[i].lang_pred == net.langs[int(total.argmax())] and abs(got[i].score - (soft / soft.sum()).max()) < 1e-5

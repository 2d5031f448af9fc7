import random
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import map_rows


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fp); every pair is compared."""
    parent = {i: i for i, _ in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i, _ in prints}


def test_fingerprints_and_components(spark):
    r = random.Random(9)
    texts = [None, "", " \t", "One", "one", "two words", "a B c d", "a\x0bb c  d", "é ü ß x y", "w " * 50000]
    base = [" ".join(r.choices("alpha beta gamma delta eps zeta".split(), k=60)) for _ in range(8)]
    for b in base:
        for _ in range(12):
            words = b.split()
            for _ in range(r.randint(0, 2)):
                words[r.randrange(60)] = r.choice(["x", "y", "z"])
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(1000 - i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    docs = docs.unionByName(docs.where("doc_id = 990"))
    rows = simhash.near_duplicates(docs).collect()
    prints = {1000 - i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert len(rows) == len(texts) + 1
    assert {x.doc_id: x.fingerprint for x in rows} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {x.doc_id: x.component_id for x in rows} == brute_components(sorted(prints.items()))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(brute_components(sorted(prints.items())).values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def cluster(n, seed, flips):
    r = random.Random(seed)
    centre, found = r.getrandbits(64), set()
    while len(found) < n:
        x = centre
        for _ in range(r.randint(0, flips)):
            x ^= 1 << r.randrange(64)
        found.add(x)
    return sorted(found)


def test_crowded_keys_lose_no_link(spark):
    """With few members held, keys pass to the second level; with few compared directly, masks are looked up."""
    prints = list(enumerate(cluster(150, 1, 6) + cluster(100, 2, 9) + [random.Random(3).getrandbits(64) for _ in range(50)]))
    frame = spark.createDataFrame([(i, simhash.signed(f)) for i, f in prints], "doc_id long, fp long")
    want = brute_components(prints)
    for held, direct in ((1 << 17, 1024), (3, 1024), (1, 2), (20, 2)):
        before, simhash.DIRECT = simhash.DIRECT, direct
        try:
            parts = simhash.class_components(frame, held=held).join(frame, "fp").collect()
        finally:
            simhash.DIRECT = before
        assert {x.doc_id: x.component_id for x in parts} == want, (held, direct)


def test_link_group_by_masks_equals_pairs():
    import numpy as np

    fps = np.array(cluster(400, 4, 4), np.uint64)
    same_half = np.unique(fps & np.uint64(0xFFFFFFFF) | np.uint64(5 << 32))
    before = simhash.DIRECT
    a = simhash.link_group(same_half, 0, list(range(32)))
    simhash.DIRECT = 1
    b = simhash.link_group(same_half, 0, list(range(32)))
    simhash.DIRECT = before
    assert [x.tolist() for x in a] == [x.tolist() for x in b] and len(a[0])


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    assert map_rows(docs, count, "n long").agg(F.max("n")).first()[0] <= 10

"""Near-copies by the Jaccard similarity of word shingles, for the corpus pipeline.

Documents are near-copies if their sets of ``SHINGLE``-word shingles have a similarity of ``SIMILARITY`` or more, and all that
near-copies connect are one group. Words are those of ``simhash``; a shingle is held as its XXH64 hash.

The join is exact. Documents with equal sets are a class. Shingles are ordered by how many classes have them, rarest first, then
by hash. Two similar sets share one of the first few shingles of both (prefix filter), and where the first such one stands leaves
room for what they must share (positional filter, which holds the length filter too). What rare shingles a document has are its
own changes, so copies with many changes share no key, and those with few share the keys of what they were copied from.

Every shingle of every class is counted, by the upper 48 bits of its hash (shingles that agree in them count together, which is
an order as good). ``tokens`` deals them to ranges of hashes, packed into bytes with the row they come from, about six bytes each
on disk; a range sends back those found twice or more with their counts. Those found once stand first in a set and are no keys,
so a set has keys only if four fifths of it are found elsewhere. Texts go through no shuffle: which rows are wanted is broadcast
as a bitmap (``chosen``), about a quarter of a byte for each row.

The members of a key are first compared with its head, the one with the fewest rarer shingles, which is the original or close to
it; that is one comparison for each member, whatever the size of the key, and connects most. Rounds with the next heads go on
while they connect a hundredth of the members left; then all pairs that are not connected yet and pass the filters are checked on
their whole sets, so no link is left out.

Defined results: texts without a word are one class; texts of fewer than ``SHINGLE`` words are one shingle; texts of any length
count whole; of a group the row with the smallest id stays (null last; of rows repeated with it, one); an empty table gives no
rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, map_rows, materialize, sized
from .components import components
from .simhash import _LOWER, SEED

SHINGLE = 5
SIMILARITY = 0.8
#: Hashes are dealt by their upper bits, so many values, to ranges of about ``RANGE`` shingles.
BUCKETS = 1 << 16
RANGE = 2 << 20
#: Shingles are packed for 2 ** ``BLOCK`` rows at a time, or ``PACK`` shingles.
BLOCK = 9
PACK = 1 << 20


def shingles(text: bytes | None) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    words, digest = (text or b"").translate(_LOWER).split(), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    return np.unique(np.array([digest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(SHINGLE)), strict=False)], np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 as bytes: no more for each than the largest takes, and all first bytes before all second ones, since they
    compress apart."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, : packed[0]] = planes.T
    return whole.view("<u8").ravel().astype(np.int64)


def prefix(hashes: np.ndarray, counts: np.ndarray, at: np.ndarray | None = None, n: int | None = None) -> np.ndarray:
    """The shingles, in order, of which a set similar to this one shares at least one: rarest first, then by hash. ``at`` is the
    place of each one's count, by default its upper bits. Of a set of ``n``, those that no other set has may be left out."""
    n = len(hashes) if n is None else n
    at = (hashes >> np.uint64(48)).astype(np.int64) if at is None else at
    most = n - int(np.ceil(SIMILARITY * n - 1e-6)) + 1 - (n - len(hashes))
    return hashes[np.lexsort((hashes, counts[at]))[: max(0, most)]].view(np.int64)


def mark(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with a number, and the digest and size of their set."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], f"{OWN}set", f"{OWN}n"])

    own = [docs[f"`{c}`"] for c in names]
    numbered = docs.select(*own, F.monotonically_increasing_id().alias(f"{OWN}uid"), F.col(f"`{text_col}`").cast("string").cast("binary").alias(f"{OWN}text"))
    schema = T.StructType(numbered.schema.fields[:-1]).add(f"{OWN}set", "binary").add(f"{OWN}n", "long")
    return materialize(map_rows(numbered, run, schema), "near-docs")


def chosen(rows: DataFrame, uids: DataFrame, uid: str = "uid") -> DataFrame:
    """The rows whose number is among ``uids``, whatever their count, without a shuffle of the rows: bits of 4096 numbers make a
    row of the table that is broadcast."""
    at = F.col(uids.columns[0])
    words = uids.select(at.alias("u")).groupBy(F.expr("u div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(u % 64 as int)))").alias("bits"))
    blocks = words.groupBy(F.expr("word div 64").alias(f"{OWN}block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("word % 64").alias("word"), "bits"))).alias(f"{OWN}bits"))
    found = rows.join(F.broadcast(blocks), F.expr(f"`{uid}` div 4096") == F.col(f"{OWN}block"))
    return found.where(F.expr(f"bit_get({OWN}bits[`{uid}` div 64 % 64], cast(`{uid}` % 64 as int)) = 1")).select(*[rows[f"`{c}`"] for c in rows.columns])


def tokens(texts: DataFrame, ranges: int) -> DataFrame:
    """(range, block, packed): the upper bits of the shingles of the texts of (uid, text), with the place of their row in its block."""

    def packed(block: int, places: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, rows = np.concatenate(found) >> np.uint64(16), np.repeat(places, [len(x) for x in found])
        order = np.argsort(hashes, kind="stable")
        hashes, rows = hashes[order].astype(np.int64), rows[order]
        dealt = (hashes >> 32) * ranges // BUCKETS
        cuts = np.flatnonzero(np.diff(dealt, prepend=-1))
        made = []
        for start, end in zip(cuts, [*cuts[1:], len(hashes)], strict=True):
            made.append((pack(np.diff(hashes[start:end], prepend=hashes[start])), pack(rows[start:end]), int(hashes[start])))
        n = len(made)
        yield pa.RecordBatch.from_arrays([pa.array(dealt[cuts], pa.int32()), pa.array([block] * n, pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)]], names=["range", "block", "steps", "rows", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places, found, held = -1, [], [], 0
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (uid >> BLOCK != block or held >= PACK):
                    yield from packed(block, places, found)
                    places, found, held = [], [], 0
                block, hashes = uid >> BLOCK, shingles(text)
                places.append(uid & (1 << BLOCK) - 1)
                found.append(hashes)
                held += len(hashes)
        if held:
            yield from packed(block, places, found)

    return map_rows(texts, run, "range int, block long, steps binary, rows binary, first long")


def counted(table: pa.Table) -> pa.Table:
    """Of the shingles of a range, those found twice or more, with their counts."""
    steps, rows, first = table["steps"], table["rows"], table["first"].to_numpy()
    hashes = lambda i: np.cumsum(unpack(steps[i].as_py())) + first[i]
    seen = [np.unique(hashes(i), return_counts=True) for i in range(len(first))]
    every, inverse = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
    number = np.bincount(inverse, np.concatenate([n for _, n in seen])).astype(np.int64)
    every, number = every[number > 1], number[number > 1]
    made = []
    for i in range(len(first) if len(every) else 0):
        here = hashes(i)
        at = np.minimum(np.searchsorted(every, here), len(every) - 1)
        if (again := every[at] == here).any():
            known = here[again]
            made.append((table["block"][i].as_py(), pack(np.diff(known, prepend=known[0])), pack(unpack(rows[i].as_py())[again]), int(known[0]), pack(number[at[again]])))
    columns = list(zip(*made, strict=True)) or [()] * 5
    names, types = ["block", "steps", "rows", "first", "counts"], (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def block_keys(known: pa.Table, sizes: pa.Table) -> pa.Table:
    """(uid, n, at, key) of a block's rows, from their shingles that are found elsewhere and the sizes of their sets."""
    parts = [[np.cumsum(unpack(x["steps"])) + x["first"], unpack(x["rows"]), unpack(x["counts"])] for x in known.to_pylist()]
    columns: list[list[np.ndarray]] = [[], [], [], []]
    if parts:
        hashes, rows, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(rows, kind="stable")
        hashes, counts, ends = hashes[order], counts[order], np.cumsum(np.bincount(rows, minlength=1 << BLOCK))
        for uid, n in zip(sizes["uid"].to_pylist(), sizes["n"].to_pylist(), strict=True):
            end = ends[uid & (1 << BLOCK) - 1]
            start = ends[(uid & (1 << BLOCK) - 1) - 1] if uid & (1 << BLOCK) - 1 else 0
            keys = prefix(hashes[start:end].view(np.uint64), counts[start:end], np.arange(end - start), n)
            for c, x in zip(columns, (np.full(len(keys), uid), np.full(len(keys), n), np.arange(len(keys)) + n - (end - start), keys), strict=True):
                c.append(x)
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.table([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]), t) for c, t in zip(columns, types, strict=True)], names=["uid", "n", "at", "key"])


def keys(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, n, at, key): the prefixes of the classes (uid, n), as far as other classes have their shingles, too."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    ranges = min(BUCKETS, -(-total // RANGE) or 1)
    known = tokens(chosen(texts, classes.select("uid")), ranges).groupBy("range").applyInArrow(counted, "block long, steps binary, rows binary, first long, counts binary")
    sizes = classes.select("uid", "n", F.shiftright("uid", BLOCK).alias("block"))
    return known.groupBy("block").cogroup(sizes.groupBy("block")).applyInArrow(block_keys, "uid long, n int, at int, key long")


def sets(texts: DataFrame) -> DataFrame:
    """(uid, hashes) of (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                hashes = pa.array(shingles(text).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), hashes)], names=["uid", "hashes"])

    return map_rows(texts, run, "uid long, hashes array<long>")


def similar(pairs: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, from their whole sets; only texts in a pair are read again."""
    pairs = materialize(pairs.distinct(), f"near-pairs-{turn}")
    nodes = materialize(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct(), f"near-nodes-{turn}")
    hashes = materialize(sets(chosen(texts, nodes)), f"near-sets-{turn}")
    of = lambda c: hashes.select(F.col("uid").alias(c), F.col("hashes").alias(f"set_{c}")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return materialize(both.where(F.col("common") >= SIMILARITY * (F.col("total") - F.col("common")) - 1e-9).select("a", "b"), f"near-links-{turn}")


def roomy(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether sets that first share a shingle at these places can share enough from there on."""
    return F.least(n_a - at_a, n_b - at_b) >= F.ceil(SIMILARITY / (1 + SIMILARITY) * (n_a + n_b) - 1e-6)


def connected(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the classes (uid, n) that have a near-copy."""
    members = materialize(keys(classes, texts), "near-members")
    shared = materialize(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "near-shared")
    held = materialize(members.join(sized(shared), "key", "left_semi").withColumn("root", F.col("uid")), "near-keys")
    links, turn = None, 0
    while True:
        turn += 1
        first = F.min(F.struct("at", "uid", "n", "root")).alias("h")
        heads = held.groupBy("key").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
        heads = materialize(heads.select("key", F.col("h.at").alias("at_h"), F.col("h.uid").alias("uid_h"), F.col("h.n").alias("n_h"), F.col("h.root").alias("root_h")), f"near-heads-{turn}")
        open_ = held.join(sized(heads, 3), "key").where("uid != uid_h")
        pairs = open_.where((F.col("root") != F.col("root_h")) & roomy(F.col("n"), F.col("at"), F.col("n_h"), F.col("at_h"))).select(F.col("uid_h").alias("a"), F.col("uid").alias("b"))
        new = similar(pairs, texts, turn)
        links = new if links is None else links.unionByName(new)
        labels, found = components(links), new.count()
        left = open_.select("key", "uid", "n", "at").join(sized(labels), F.col("uid") == F.col("node"), "left")
        held = materialize(left.select("key", "uid", "n", "at", F.coalesce("root", "uid").alias("root")), f"near-left-{turn}")
        if 100 * found <= held.select("uid").distinct().count():
            break
    a, b = held.alias("a"), held.alias("b")
    longer = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.uid") < F.col("b.uid")))
    apart = (F.col("a.root") != F.col("b.root")) & longer & roomy(F.col("a.n"), F.col("a.at"), F.col("b.n"), F.col("b.at"))
    short = roomy(F.col("b.n"), F.col("b.at"), F.col("b.n"), F.col("b.at"))  # the shorter set must share from an earlier place on
    new = similar(a.join(b.where(short), (F.col("a.key") == F.col("b.key")) & apart).select(F.col("a.uid").alias("a"), F.col("b.uid").alias("b")), texts, 0)
    return labels if new.isEmpty() else components(links.unionByName(new))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-copies."""
    names, uid = docs.columns, f"{OWN}uid"
    marked = mark(docs, id_col, text_col)
    rows = marked.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(uid).alias("uid"), F.col(f"{OWN}set").alias("set"), F.col(f"{OWN}n").alias("n"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    classes = materialize(rows.groupBy("set").agg(least, F.min("n").alias("n")).select("first", F.col("first.uid").alias("uid"), "n"), "near-classes")
    labels = connected(classes.select("uid", "n").where("n > 0"), marked.select(F.col(uid).alias("uid"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")))
    roots = classes.join(sized(labels), F.col("uid") == F.col("node"), "left").groupBy(F.coalesce("root", "uid").alias("root")).agg(F.min("first").alias("first"))
    kept = materialize(roots.select(F.col("first.uid").alias(uid)), "near-kept")
    return chosen(marked, kept, uid).select(*[F.col(f"`{c}`") for c in names])

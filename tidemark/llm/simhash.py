"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is the majority of its shingles' XXH64 hashes, bit by bit. Two fingerprints that differ in at
most two bits have, of their two 32-bit halves, one that differs in one bit at most. So each half is indexed as it is and
with each of its bits as a wildcard: equality of such a key, then a check of all 64 bits, finds every link.

Documents with one fingerprint are a class, and only classes are indexed. Keys are shuffled once and sorted; a task
streams over its keys and gives, for the classes under a key, a spanning forest of the links among them, not all pairs.
Small groups are compared directly, larger ones by looking up each of the masks of at most two bits (linear in the
group). No key of more than ``HELD`` classes goes to a task: classes are counted by half first (a wildcard key has the classes of
two halves), and members of crowded keys go to keys that split the other half in the same way, whose groups can't be larger than
2^17 classes by their number of free bits. Components of the links give each document the smallest id that it is connected with.

Defined results: a null text, or one without a word, has fingerprint zero and links like any other; fewer than three
words are one shingle; texts of any length are hashed whole, in parts; of a tie of ones and zeros a bit is 0; repeated rows are
one class; a null id never names a component that has another id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, map_rows, materialize, read, sized
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Classes of a key that a task holds at most.
HELD = 1 << 17
#: Groups up to this size are compared pair by pair.
DIRECT = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, 1 << 14):
        part = words[at : at + (1 << 14) + SHINGLE - 1]
        hashes = np.array([digest(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:], strict=False)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signed(fingerprint(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=[id_col, "fp"])

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")), run, f"{id_col} long, fp long")


def keys(rows: DataFrame) -> DataFrame:
    """Rows (key, fp) of the index: bits 32 and up of a key say which half and wildcard it is (0, 1: none; then 2 + 32 * half + bit)."""
    halves = (F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    whole = [F.lit(h << 32).bitwiseOR(half) for h, half in enumerate(halves)]
    wild = [F.lit((2 + 32 * h + bit) << 32).bitwiseOR(half.bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << bit))) for h, half in enumerate(halves) for bit in range(32)]
    return rows.select(F.explode(F.array(*whole, *wild)).alias("key"), "fp")


def must_differ(key: int) -> int:
    """The bit in which linked members of a key differ (its wildcard), as a mask; 0 where the half is equal."""
    variant = key >> 32
    return 0 if variant < 2 else 1 << (variant - 2)


def free_bits(key: int) -> list[int]:
    variant = key >> 32
    half = variant if variant < 2 else (variant - 2) // 32
    return list(range(32 * (1 - half), 32 * (1 - half) + 32))


def link_group(fps: np.ndarray, must: int, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints (uint64) that differ in ``must`` and in ``free`` bits only: (member, smallest member of its tree)."""
    fps = np.sort(fps)
    left = DISTANCE - bool(must)
    if len(fps) <= DIRECT:
        pairs = [[], []]
        for at in range(0, len(fps), 256):
            xor = fps[at : at + 256, None] ^ fps[None, :]
            near = np.bitwise_count(xor) <= DISTANCE
            if must:
                near &= (xor & np.uint64(must)) != 0
            i, j = np.nonzero(near)
            use = i + at < j
            pairs[0].append(i[use] + at)
            pairs[1].append(j[use])
        i, j = np.concatenate(pairs[0]), np.concatenate(pairs[1])
    else:
        masks = [must] if must else []
        masks += [must | 1 << a for a in free] if left else []
        masks += [1 << a | 1 << b for n, a in enumerate(free) for b in free[n + 1 :]] if left > 1 else []
        pairs = [[], []]
        for mask in masks:
            other = fps ^ np.uint64(mask)
            place = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = np.flatnonzero((fps[place] == other) & (np.arange(len(fps)) < place))
            pairs[0].append(hit)
            pairs[1].append(place[hit])
        i, j = np.concatenate(pairs[0]), np.concatenate(pairs[1])
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, label[i], label[j])
        np.minimum.at(new, label[j], label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    joined = label != np.arange(len(fps))
    return fps[joined], fps[label[joined]]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Runs of equal leading columns in sorted batches, as (columns, starts of whole runs)."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate((a, b)) for a, b in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        new = np.zeros(len(columns[0]), bool)
        new[0] = True
        for c in columns[:-1]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1])
        if last:
            yield [c[:last] for c in columns], starts[:-1]
        rest = [c[last:] for c in columns]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _rows(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], names=["a", "b"])


def link_keys(index: DataFrame) -> DataFrame:
    """Links (a, b) among the classes under each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, fp), starts in groups(batches):
            fp = fp.astype(np.int64).view(np.uint64)
            sizes = np.diff(np.append(starts, len(key)))
            two = starts[sizes == 2]
            if len(two):
                a, b, k = np.maximum(fp[two], fp[two + 1]), np.minimum(fp[two], fp[two + 1]), key[two] >> 32
                xor = a ^ b
                must = np.where(k < 2, 0, np.left_shift(np.uint64(1), np.maximum(k - 2, 0).astype(np.uint64)))
                near = (np.bitwise_count(xor) <= DISTANCE) & ((must == 0) | ((xor & must) != 0))
                yield _rows(a[near], b[near])
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                k = int(key[start])
                a, b = link_group(fp[start : start + size], must_differ(k), free_bits(k))
                if len(a):
                    yield _rows(a, b)

    return map_rows(index.repartition("key").sortWithinPartitions("key", "fp"), run, "a long, b long")


def crowded_keys(classes: DataFrame, held: int) -> DataFrame:
    """Keys that may have more than ``held`` classes: those of halves with over half as many, whole and with each wildcard."""
    halves = (F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    sides = F.explode(F.array(*[F.struct(F.lit(h).alias("side"), half.alias("half")) for h, half in enumerate(halves)])).alias("x")
    many = classes.select(sides).groupBy("x.side", "x.half").count().where(F.col("count") > held // 2)
    of = lambda h: [F.lit(h << 32).bitwiseOR(F.col("half")), *(F.lit((2 + 32 * h + bit) << 32).bitwiseOR(F.col("half").bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << bit))) for bit in range(32))]
    return many.select(F.explode(F.when(F.col("side") == 0, F.array(*of(0))).otherwise(F.array(*of(1)))).alias("key")).distinct()


def link_crowded(members: DataFrame) -> DataFrame:
    """Links among the members of crowded keys: the other half is cut in two quarters and indexed like the halves, so a group has 17 free bits at most."""
    variant = F.shiftrightunsigned("key", 32)
    half = F.when(variant < 2, variant).otherwise(F.floor((variant - 2) / 32))
    other = F.when(half == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    quarters = (F.col("other").bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned("other", 16))
    subkeys = [F.lit(q << 16).bitwiseOR(x) for q, x in enumerate(quarters)]
    subkeys += [F.lit((2 + 16 * q + bit) << 16).bitwiseOR(x.bitwiseAND(F.lit(0xFFFF ^ 1 << bit))) for q, x in enumerate(quarters) for bit in range(16)]
    index = members.select("key", "fp", other.alias("other")).select("key", F.explode(F.array(*subkeys)).alias("sub"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, sub, fp), starts in groups(batches):
            fp = fp.astype(np.int64).view(np.uint64)
            sizes = np.diff(np.append(starts, len(key)))
            for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                k, s = int(key[start]), int(sub[start]) >> 16
                quarter, free = (s if s < 2 else (s - 2) // 16), free_bits(k)
                free = [x for i, x in enumerate(free) if i // 16 != quarter] + ([free[16 * quarter + (s - 2) % 16]] if s >= 2 else [])
                a, b = link_group(fp[start : start + size], must_differ(k), free)
                if len(a):
                    yield _rows(a, b)

    return map_rows(index.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp"), run, "a long, b long")


def links(classes: DataFrame, held: int = HELD) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that connect just those that links of two bits or fewer connect."""
    index, crowded = keys(classes.select("fp")), materialize(crowded_keys(classes, held), "simhash-crowded")
    if crowded.isEmpty():
        return link_keys(index)
    mine = sized(crowded)
    return link_keys(index.join(mine, "key", "left_anti")).unionByName(link_crowded(index.join(mine, "key", "left_semi")))


def class_components(prints: DataFrame, id_col: str = "doc_id", held: int = HELD) -> DataFrame:
    """(fp, component_id): for each class, the smallest id among the documents that it is connected with."""
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-classes")
    n = classes.count()
    roots = components(links(classes, held))
    joined = classes.join(sized(roots.withColumnRenamed("node", "fp"), rows=n), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "simhash-roots", rows=n)
    least = materialize(joined.join(sized(joined.where("root != fp").select("root").distinct(), rows=n), "root").groupBy("root").agg(F.min("first").alias("least")), "simhash-least", rows=n)
    return materialize(joined.join(sized(least, rows=n), "root", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-components", rows=n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """(id, fingerprint, component_id) of every document."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    joined = prints.join(sized(class_components(prints, id_col, held)), "fp")
    return joined.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component, the row with the smallest id (null last; of rows repeated with it, one)."""
    uid, fp = f"{OWN}uid", f"{OWN}fp"
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([signed(fingerprint(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], fp])

    numbered = docs.select(*[docs[f"`{c}`"] for c in names], F.monotonically_increasing_id().alias(uid), F.col(text_col).cast("binary").alias(fp))
    schema = docs.select(*[docs[f"`{c}`"] for c in names], F.lit(0).cast("long").alias(uid), F.lit(0).cast("long").alias(fp)).schema
    marked = materialize(map_rows(numbered, run, schema), "simhash-docs")
    prints = marked.select(F.col(id_col).cast("long").alias("id"), F.col(uid).alias("uid"), F.col(fp).alias("fp"))
    where = class_components(prints.select("id", "fp"), "id")
    first = prints.join(sized(where), "fp").groupBy(F.coalesce("component_id", F.col("fp")).alias("component_id"), F.col("component_id").isNull().alias("none")).agg(F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("first"))
    kept = materialize(first.select(F.col("first.uid").alias(uid)), "simhash-kept")
    return marked.join(sized(kept), uid, "left_semi").select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))

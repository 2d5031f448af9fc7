"""Best-fit packing of token sequences with certified bin counts.

``tokenize`` cuts documents into pieces of at most ``CAPACITY`` tokens. ``pack`` deals the pieces shorter than that out to
partitions of about ``PER_PARTITION`` (by a hash of the row, so equal documents spread), packs each by best-fit decreasing
and certifies it: dual feasible functions give a lower bound of its bins, and a partition that meets its bound is final.
Partitions with a gap then exchange documents: those in their bins that aren't full, and those in the emptiest bin of
every partition, are pooled, dealt anew to partitions twice as large as before (up to ``MOST_ROWS``) and packed again. A round
that saves no bin is undone. Rounds go on until all bins together meet the bound of the whole table (from its counts by length),
until nothing is left to exchange, or until a round with the largest partitions saves no more than ``WORTH`` of what it repacked. A partition's rows (numbers only) are at most about ``MOST_ROWS``; no text and no
list of tokens goes through a shuffle.

Every piece comes with its ``partition`` and that one's ``bins`` and ``bound``: where they are equal, no packing of what the
partition has needs fewer. A partition that gave bins away keeps its certificate: taking a bin's pieces out lowers the least
number of bins by one at most, and bins that are full are as few as can be.

Token ids are those of the ``tokenizers`` file. Texts of plain Latin characters go through a faster encoder of the same
vocabulary; all others, and those with very long runs or a special token's string, through ``tokenizers`` itself.

Defined results: a null or empty text is the end token alone; a text of any length is encoded whole; pieces of equal length
are packed in order of their number; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, read, sized

CAPACITY = 2048
END = 0
PER_PARTITION = 20000
MOST_ROWS = 1 << 18
#: The share of the bins that a round repacks which it must save for another round of the largest partitions.
WORTH = 0.001
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks, for the faster encoder.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = re.compile(r"[\x00-ɏ‐-‧€]*\Z")
#: A text with a longer word, or with this many blanks more than words, goes to the exact encoder.
LONG_RUN = 1000

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
_PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_ENCODERS: dict[tuple[str, str], Callable[[str], list[int]]] = {}


def encoder(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> Callable[[str], list[int]]:
    """Text to ids; made once in each worker."""
    if (tokenizer, ranks) not in _ENCODERS:
        import base64

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(tokenizer)
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            words = list(map(len, text.split()))
            runs = max(words, default=0) > LONG_RUN or len(text) - sum(words) - len(words) > LONG_RUN
            if runs or not PLAIN.match(text) or any(s in text for s in special):
                return exact.encode(text, add_special_tokens=False).ids
            return fast(text)

        _ENCODERS[tokenizer, ranks] = encode
    return _ENCODERS[tokenizer, ranks]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sequences but for the first, which takes the rest."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n > capacity else [(0, n)]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """A row per piece; ``uid`` numbers the pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = encoder(tokenizer, ranks), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((uid, key, number, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    uid += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(_PIECE_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], names=_PIECE_NAMES)

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), pieces, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length and the number of bins. Open bins are kept by the room they have left."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - left
        left -= size
        if left:
            room[left].append(at)
            open_rooms |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, most_k: int = 24) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity, most_k)


def bound_of_counts(counts: np.ndarray, capacity: int = CAPACITY, most_k: int = 24) -> int:
    """The largest bound, from how many pieces have each length, that these dual feasible functions give: identity, the threshold
    family (small sizes to 0, sizes that leave no room for them to 1) and the rounding family with 1..most_k steps, alone and after
    a threshold."""
    x = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * x)))
    e = np.arange(0, capacity // 2 + 1)
    above = number[capacity + 1] - number[capacity - e + 1]
    best = int((-(-(above * capacity + volume[capacity - e + 1] - volume[e]) // capacity)).max())
    for k in range(1, most_k + 1):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        for threshold in (0, capacity // (k + 1)):
            moved = np.where(x > capacity - threshold, k * capacity, np.where(x < threshold, 0, value))
            best = max(best, -(-int((counts * moved).sum()) // (k * capacity)))
    return best


def _pack_group(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", kind="stable")
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths, n).astype(np.int64)
        # Of the fills below capacity, the smallest has level 0, the next one 1.
        level = np.where(fill < capacity, np.unique(fill, return_inverse=True)[1], -1)
        return rows.assign(sequence_id=(rows["partition"].to_numpy(np.int64) << 24) + bins, offset=offsets, level=level[bins], bins=np.int64(n), bound=np.int64(lower_bound(lengths, capacity)))

    return run


_PACKED = PIECES + ", partition long, sequence_id long, offset long, level long, bins long, bound long"


def _deal(rows: DataFrame, parts: int, turn: int, first: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to ``parts`` partitions, numbered from ``first``, and packed; and a row per partition with its certificate."""
    dealt = rows.select(*_PIECE_NAMES, (F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(parts)) + first).alias("partition"))
    packed = materialize(dealt.groupBy("partition").applyInPandas(_pack_group(capacity), _PACKED), f"packed-{turn}")
    certificates = materialize(packed.groupBy("partition").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound")), f"certificates-{turn}", rows=parts)
    return packed.withColumn("gap", F.col("bins") > F.col("bound")).drop("bins", "bound"), certificates


def least_bins(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """The bound of a whole table, from one row per length."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return bound_of_counts(counts, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, and their partition's certificate; pieces of full capacity are sequences, and partitions, of their own (negative numbers)."""
    short = pieces.where(F.col("length") < capacity)
    parts, least = max(1, -(-short.count() // per_partition)), least_bins(short, capacity)
    current, certified = _deal(short, parts, 0, 0, capacity)
    next_id, turn = parts, 0
    total = certified.agg(F.sum("bins")).first()[0] or 0
    while total > least:
        turn += 1
        # A partition gives its emptiest bins, and one with a gap all that aren't full. Rows know that without a join.
        given = (F.col("level") == 0) | (F.col("gap") & (F.col("level") >= 0))
        pool = materialize(current.where(given), f"pool-{turn}")
        lost = materialize(pool.groupBy("partition").agg(F.countDistinct("sequence_id").alias("lost"), F.count("*").alias("rows")), f"lost-{turn}")
        state = lost.agg(F.count("*").alias("parts"), F.sum("lost").alias("bins"), F.sum("rows").alias("rows")).first()
        if state["parts"] < 2:
            break
        parts = max(1, -(-state["rows"] // min(MOST_ROWS, per_partition << turn)))
        again, certified_again = _deal(pool, parts, turn, next_id, capacity)
        saved = state["bins"] - certified_again.agg(F.sum("bins")).first()[0]
        if saved <= WORTH * state["bins"] and (parts == 1 or per_partition << turn >= MOST_ROWS):
            break
        if saved <= 0:
            continue
        left = certified.join(sized(lost.select("partition", "lost"), rows=next_id), "partition", "left").select("partition", (F.col("bins") - F.coalesce("lost", F.lit(0))).alias("bins"))
        # Where no gap was, taking bins out leaves none; where one was, all that isn't full was given, and full bins are as few as can be.
        certified = materialize(left.withColumn("bound", F.col("bins")).unionByName(certified_again), f"certificates-all-{turn}", rows=next_id + parts)
        next_id, total = next_id + parts, total - saved
        kept = current.where(~given).withColumn("gap", F.lit(False)).withColumn("level", F.greatest(F.col("level") - 1, F.lit(-1)))
        current = materialize(kept.unionByName(again), f"packed-all-{turn}")
    current = current.join(sized(certified, rows=next_id), "partition")
    one, own = F.lit(1).cast("long"), (-1 - F.col("uid"))
    whole = pieces.where(F.col("length") >= capacity).select(*_PIECE_NAMES, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), own.alias("partition"), one.alias("bins"), one.alias("bound"))
    return whole.unionByName(current.select(*_PIECE_NAMES, "sequence_id", "offset", "partition", "bins", "bound"))


def pack_documents(docs: DataFrame, **columns) -> DataFrame:
    return pack(materialize(tokenize(docs, **columns), "pieces")).drop("uid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))

"""Language identification by a byte-level convolutional network, trained in numpy.

Texts are lower-cased UTF-8 cut into windows of ``WINDOW`` bytes. A window goes through an embedding of its bytes, filters
of several widths, ReLU, a maximum over the window, a dense layer and softmax; a text's log-probabilities are the means
over all its windows, weighted by their bytes. ``train`` fits the network by Adam on a bounded sample of labelled rows:
one window per sampled row, about ``PER_LANG`` rows a language and ``MAX_ROWS`` in all. Prediction covers whole texts.

On the main path a filter's value at a place is a sum of table entries: as the embedding has 256 rows, what bytes (0, 1)
and (2, 3) of a filter give is kept for all 65,536 byte pairs, so a window needs two look-ups a byte for all filters.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without labelled rows every text is
``und``; every labelled language is learned: where ``PER_LANG`` rows of each are more than ``MAX_ROWS``, all big languages give
equally many, ``LEAST`` at least, so beyond ``MAX_ROWS / LEAST`` languages the sample grows with their number; rows with a null
language are not learned from; a text of any length counts with all its windows; of languages that score equally the first by
name is given; repeated rows give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_rows, read, uniform

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDED = 8
#: The labelled sample: rows of a language and rows in all.
PER_LANG = 1200
MAX_ROWS = 12000
#: Rows of a language, if it has them, however many languages there are.
LEAST = 32
EPOCHS = 5
BATCH = 64
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBEDDED
    filters: dict[int, np.ndarray]  # width -> width x EMBEDDED x FILTERS
    bias: np.ndarray  # of all filters
    dense: np.ndarray  # filters x languages
    dense_bias: np.ndarray


def to_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n x WINDOW + 3 bytes, the last ones of the window after it or zero), their texts' numbers and weights."""
    counts = np.array([max(1, -(-len(x) // WINDOW)) for x in data], np.int64)
    sizes = np.array([len(x) for x in data], np.int64)
    strides = counts * WINDOW + 3
    offsets = np.concatenate(([0], np.cumsum(strides)))
    buffer = np.zeros(int(offsets[-1]), np.uint8)
    for at, x in zip(offsets.tolist(), data, strict=False):
        buffer[at : at + len(x)] = np.frombuffer(x, np.uint8)
    owner = np.repeat(np.arange(len(data)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + number * WINDOW
    weight = np.clip(sizes[owner] - number * WINDOW, 1, WINDOW) / WINDOW
    return buffer[starts[:, None] + np.arange(WINDOW + 3)], owner, weight


def tables(net: Net) -> tuple[np.ndarray, np.ndarray]:
    """For every byte pair: what it gives as bytes 0, 1 of all filters, and as bytes 2, 3 of those wider than 2."""
    part = {(w, j): net.embed @ net.filters[w][j] for w in WIDTHS for j in range(w)}
    zero = np.zeros((256, FILTERS), np.float32)
    pair = lambda j, ws: np.concatenate([(part[w, j][:, None] + part.get((w, j + 1), zero)[None]).reshape(65536, FILTERS) for w in ws], axis=1)
    return np.ascontiguousarray(pair(0, WIDTHS) + net.bias), np.ascontiguousarray(pair(2, WIDTHS[1:]))


def log_probabilities(net: Net, made: tuple[np.ndarray, np.ndarray], grid: np.ndarray) -> np.ndarray:
    first, second = made
    out = np.empty((len(grid), len(net.langs)), np.float32)
    for at in range(0, len(grid), 64):
        part = grid[at : at + 64].astype(np.int32)
        pairs = part[:, :-1] << 8 | part[:, 1:]
        value = first[pairs[:, :WINDOW]]
        value[:, :, FILTERS:] += second[pairs[:, 2:]]
        hidden = np.maximum(value.max(axis=1), 0)
        logits = hidden @ net.dense + net.dense_bias
        logits -= logits.max(axis=1, keepdims=True)
        out[at : at + 64] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return out


def fit(data: list[bytes], labels: list[str], seed: int = 1) -> Net:
    """Train on one window of bytes per row."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.searchsorted(langs, labels)
    grid, owner, _ = windows([x[:WINDOW] for x in data])
    n_all = FILTERS * len(WIDTHS)
    p = {"embed": rng.normal(0, 0.5, (256, EMBEDDED)), "bias": np.zeros(n_all), "dense": rng.normal(0, 0.3, (n_all, len(langs))), "dense_bias": np.zeros(len(langs))}
    p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDED), (w, EMBEDDED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(langs))) / len(langs)).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(owner))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, target, b = grid[rows].astype(np.int64), y[owner[rows]], len(rows)
            best, top = [], []
            for i, w in enumerate(WIDTHS):
                value = np.broadcast_to(p["bias"][i * FILTERS : (i + 1) * FILTERS], (b, WINDOW, FILTERS)).copy()
                for j in range(w):
                    value += (p["embed"] @ p[f"f{w}"][j])[x[:, j : j + WINDOW]]
                best.append(value.argmax(axis=1))
                top.append(np.take_along_axis(value, best[-1][:, None], axis=1)[:, 0])
            raw = np.concatenate(top, axis=1)
            hidden = np.maximum(raw, 0)
            logits = hidden @ p["dense"] + p["dense_bias"]
            soft = np.exp(logits - logits.max(axis=1, keepdims=True))
            soft /= soft.sum(axis=1, keepdims=True)
            soft[np.arange(b), target] -= 1
            soft *= weight[target][:, None] / b
            g = {"dense": hidden.T @ soft, "dense_bias": soft.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            back = (soft @ p["dense"].T) * (raw > 0)
            g["bias"] = back.sum(axis=0)
            for i, w in enumerate(WIDTHS):
                d = back[:, i * FILTERS : (i + 1) * FILTERS]
                seen = x[np.arange(b)[:, None, None], best[i][:, :, None] + np.arange(w)]  # batch x filters x width
                g[f"f{w}"] = np.einsum("bf,bfwe->wef", d, p["embed"][seen])
                np.add.at(g["embed"], seen, d[:, :, None, None] * p[f"f{w}"].transpose(2, 0, 1)[None])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    return Net(langs, p["embed"], {w: p[f"f{w}"] for w in WIDTHS}, p["bias"], p["dense"], p["dense_bias"])


def level(counts: list[int], per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> float:
    """The rows of each language to sample, so that they make ``max_rows`` together: small languages give all they have and leave their share to the others."""
    left, counts = max_rows, sorted(counts)
    for i, n in enumerate(counts):
        share = left / (len(counts) - i)
        if n > share:
            return max(LEAST, min(per_lang, share))
        left -= n
    return per_lang


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> DataFrame:
    """A bounded sample of labelled rows: (lang, piece), a piece being one window's worth of text at a place fixed by hashing."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    share = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect()]
    if not share:
        return rows.select("lang", F.col("text").alias("piece")).limit(0)
    most = level([n for _, n in share], per_lang, max_rows)
    keep = docs.sparkSession.createDataFrame([(lang, min(1.0, most / n)) for lang, n in share], "lang string, keep double")
    order = uniform("id", F.xxhash64("text"), seed=7)
    place = F.lit(1) + F.pmod(F.xxhash64(F.lit(11), "id"), F.greatest(F.lit(1), F.length("text") - WINDOW * 3 // 4)).cast("int")
    pieces = rows.select("lang", F.col("text").substr(place, F.lit(WINDOW)).alias("piece"), order.alias("order"))
    return pieces.join(F.broadcast(keep), "lang").where(F.col("order") < F.col("keep")).orderBy("order", "lang", "piece").select("lang", "piece")


def train(docs: DataFrame, **columns) -> Net | None:
    rows = sample(docs, **columns).collect()
    rows = [r for r in rows if LETTER.search(r["piece"])]
    return fit([to_bytes(r["piece"]) for r in rows], [r["lang"] for r in rows]) if rows else None


def predict(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, lang_pred, score) of every text, from all its windows."""

    def flush(made, rows: list[tuple[int, bytes]], langs: list[str], scores: list[float]) -> None:
        if not rows:
            return
        grid, owner, weight = windows([x for _, x in rows])
        total = np.zeros((len(rows), len(net.langs)))
        np.add.at(total, owner, log_probabilities(net, made, grid) * weight[:, None])
        total /= np.bincount(owner, weight)[:, None]
        soft = np.exp(total - total.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        for (i, _), k, s in zip(rows, total.argmax(axis=1), soft.max(axis=1), strict=True):
            langs[i], scores[i] = net.langs[k], float(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tables(net) if net else None
        for batch in batches:
            langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            rows, held = [], 0
            for i, text in enumerate(batch.column(1).to_pylist() if net else []):
                if text and LETTER.search(text):
                    rows.append((i, to_bytes(text)))
                    held += len(rows[-1][1])
                    if held > batch_bytes:
                        flush(made, rows, langs, scores)
                        rows, held = [], 0
            flush(made, rows, langs, scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, f"{id_col} long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = predict(docs, net)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")

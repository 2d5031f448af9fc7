"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, for a template of m words every run of ``SPAN`` * m of them: lines, paragraphs and blank
lines don't end it, so a notice of several paragraphs is one block, and a short notice is found within a line of any length. A
block matches a template if it holds at least ``THRESHOLD`` of the template's distinct words; every template that some block of
a text matches gives its label. Short templates share most of their words (a BY notice holds six of the seven words of a BY-SA
notice), so ``best_labels`` ranks the matches: of those whose places overlap, the one of largest containment, then of most
words, keeps its label. MIT, Apache and GPL have no short template, since a phrase names them and one word would tell them apart.

The join is exact: words are ordered by the number of texts of the whole corpus that hold them, rarest first. A template of n
words that needs k of them must share one of its n - k + 1 rarest with a text (prefix filter); texts of fewer than k words are
out (length filter); at the rarest shared word, what is left of either ordered list bounds the overlap (positional filter); for
what remains, the words' places are scanned once for the best block. Templates are a parameter of checked size
(``MOST_WORDS``), held in memory by every task; texts are streamed, so nothing of the corpus is shuffled but one count per
template word and task.

Defined results: a null or empty text has no words, null places, empty labels and score 0; a text of any length is scanned
whole, in time linear in its words for each template that passes the filters; of blocks of equal containment the first counts,
of templates of equal rank the first listed; repeated rows give equal results; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read

THRESHOLD = 0.8
#: Words of a block for each word of the template, repeats counted.
SPAN = 2
MOST_WORDS = 200_000

#: Phrases of the contract, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Usual notices of licenses.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
]

#: Bytes to words: A-Z lowered; 0-9, a-z and all beyond ASCII kept; the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Entry:
    label: str
    own: tuple[bytes, ...]  # distinct words, rarest first
    need: int
    span: int


@dataclass(frozen=True)
class Match:
    label: str
    containment: float
    words: int  # of the template
    start: int  # word places of the block's first and last shared words, end exclusive
    end: int


class Index:
    """Templates under a global order of words, for the join."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float = THRESHOLD, span: int = SPAN):
        self.entries: list[Entry] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        order = lambda w: (counts.get(w, 0), w)
        vocabulary = sorted({w for _, t in templates for w in words(t.encode())}, key=order)
        if len(vocabulary) > MOST_WORDS:
            raise ValueError(f"templates have {len(vocabulary)} distinct words; at most {MOST_WORDS} are held by a task")
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        for label, text in templates:
            listed = words(text.encode())
            own = tuple(sorted(set(listed), key=self.rank.__getitem__))
            if not own:
                raise ValueError(f"the template of {label!r} has no word")
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            for place, w in enumerate(own[: len(own) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.entries), place))
            self.entries.append(Entry(label, own, need, span * len(listed)))
        self.keys = self.prefix.keys()

    def candidates(self, distinct: frozenset[bytes]) -> list[Entry]:
        """Templates that some block of a text with these words may match."""
        hits = distinct & self.keys
        if not hits:
            return []
        known = sorted(self.rank[w] for w in distinct if w in self.rank)
        place, seen, out = {r: i for i, r in enumerate(known)}, set(), []
        for w in sorted(hits, key=self.rank.__getitem__):
            for number, at in self.prefix[w]:
                entry = self.entries[number]
                if number in seen:
                    continue
                seen.add(number)  # this is the rarest word that the two share
                if len(distinct) >= entry.need and 1 + min(len(entry.own) - at - 1, len(known) - place[self.rank[w]] - 1) >= entry.need:
                    out.append(entry)
        return out

    def probe(self, found: list[bytes]) -> list[Match]:
        """Every template that a block of the words matches, at its best block."""
        return [m for e in self.candidates(frozenset(found)) if (m := best_block(found, e)) is not None]


def best_block(found: list[bytes], entry: Entry) -> Match | None:
    """The first block of most distinct words of a template, if they are enough."""
    own, best, at = set(entry.own), (0, 0, 0), 0
    places = [i for i, w in enumerate(found) if w in own]
    inside: Counter[bytes] = Counter()
    for place in places:
        inside[found[place]] += 1
        while places[at] <= place - entry.span:
            inside[found[places[at]]] -= 1
            if not inside[found[places[at]]]:
                del inside[found[places[at]]]
            at += 1
        if len(inside) > best[0]:
            best = (len(inside), places[at], place + 1)
    return Match(entry.label, best[0] / len(own), len(own), best[1], best[2]) if best[0] >= entry.need else None


def ranked(matches: list[Match]) -> list[Match]:
    """Of matches whose places overlap, the best."""
    out: list[Match] = []
    for m in sorted(matches, key=lambda m: (-m.containment, -m.words)):
        if all(m.end <= x.start or x.end <= m.start for x in out):
            out.append(m)
    return out


def count_words(docs: DataFrame, templates: list[tuple[str, str]], text_col: str = "text") -> dict[bytes, int]:
    """For each template word, the number of texts of the corpus that hold it."""
    vocabulary = frozenset(w for _, t in templates for w in words(t.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = map_rows(docs.select(F.col(text_col).cast("string").cast("binary")), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, span: int = SPAN) -> DataFrame:
    """A row per text: words, places of phrases, labels of phrases and of matched templates, the largest containment among them (a
    phrase that stands there is held whole), the labels that rank best, and the matches as (label, containment, start, end)."""
    index = Index(templates, count_words(docs, templates, text_col), threshold, span)
    sought = [(p.encode().split(), label) for p, label in phrases.items()]
    lasts = {p[-1] for p, _ in sought}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or b""
                found = words(text)
                places, base = [], set()
                if any(w in text.lower() for w in lasts):
                    for i, w in enumerate(found):
                        if w in lasts:
                            for phrase, label in sought:
                                start = i - len(phrase) + 1
                                if start >= 0 and found[start : i + 1] == phrase:
                                    places.append(start)
                                    base.add(label)
                met = index.probe(found)
                score = max([1.0] * bool(places) + [m.containment for m in met], default=0.0)
                joined = [",".join(sorted(base | {m.label for m in some})) for some in ([], met, ranked(met))]
                spans = [{"label": m.label, "containment": m.containment, "start": m.start, "end": m.end} for m in met]
                rows.append((len(found), len(places), min(places, default=None), max(places, default=None), joined[0], joined[1], score, joined[2], spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), _MATCHES)
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, *_SCANNED, "best_labels", "matches"])

    schema = f"{id_col} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, best_labels string, matches array<struct<label:string,containment:double,start:long,end:long>>"
    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")), run, schema)


_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
_SCANNED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *_SCANNED)


def _oracle() -> str:
    """Plain containment: at every place of a template's word, the distinct words of the template in the block that starts there."""
    tokens = ", ".join(f"({i}, '{label}', {SPAN * len(words(text.encode()))}, '{w.decode()}')" for i, (label, text) in enumerate(TEMPLATES) for w in sorted(set(words(text.encode()))))
    lists = ", ".join(f"({i}, '{p}', '{label}')" for i, (p, label) in enumerate(PHRASES.items()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH t(tid, label, span, token) AS (VALUES {tokens}),
ts AS (SELECT tid, count(*) AS n FROM t GROUP BY tid),
ph(pid, phrase, label) AS (VALUES {lists}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS ws FROM documents),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: array_to_string(ws[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase)) AS pos FROM w, ph),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
o AS (SELECT doc_id, tid, label, span, token, pos FROM (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM w) JOIN t USING (token)),
able AS (SELECT doc_id, tid FROM o JOIN ts USING (tid) GROUP BY doc_id, tid, n HAVING count(DISTINCT token) >= {THRESHOLD} * n - 1e-9),
p AS (SELECT o.* FROM o SEMI JOIN able USING (doc_id, tid)),
blocks AS (SELECT x.doc_id, x.tid, x.label, x.pos, count(DISTINCT y.token) AS held FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.tid = y.tid AND y.pos >= x.pos AND y.pos < x.pos + x.span GROUP BY ALL),
met AS (SELECT doc_id, label, max(held / n) AS score FROM blocks JOIN ts USING (tid) WHERE held >= {THRESHOLD} * n - 1e-9 GROUP BY doc_id, label),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT doc_id, label, score FROM met UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN labels USING (doc_id)
"""


ORACLE_SQL = _oracle()

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

``targets`` shares a multiple of all words among the sources by weight; no source gets more than ``MOST`` times its words,
and what is over is shared among the others. A source's target is made of complete epochs first; the rest is a weighted
sample without replacement: every document has a uniform number u fixed by its id, its key is -ln(u) / w with w its quality
weight, and documents are taken in order of keys until the rest of the target is full; the last one gives its first words
only, so that a source comes within a word of its target.

A source may hold a third of all rows, so no source is sorted as a whole. Rows are ordered by (key, id, hash of the text). A
source's rows are dealt to ``RANGES`` even ranges of that order; sums by range show in which one its cut lies, and that range is
dealt again between the least and the largest row that it has, until at most ``HELD`` rows are left, or rows that are all alike;
only those are sorted. Whatever the distribution of the keys, a round splits what it deals, since its ends fall in different
ranges. The cut of a source is all that the documents are joined with: a row per source, broadcast only up to a counted size.
Sources themselves are ranked by ranges, so their number isn't bound by a task either.

Everything is DataFrame expressions. Defined results: a null or wordless text has size 0 and is never taken; a null source
is a source of its own, the last; a source without words has target 0; a null id sorts as the least; ties of keys fall to the
smaller id, then to the smaller hash of the text; repeated rows share all three and are taken alike (a cut among them is split
evenly, rounded down); texts of any length count whole; an empty table gives no rows; other columns stay as they are in ``mix`` and
are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.prefix import dense_numbers

from .common import OWN, materialize, read, sized, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Ranges that a source's rows are dealt to in a round, and rows of a source that are sorted in one task.
RANGES = 1024
HELD = 4096

ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             0.1 + 0.9 * greatest(0.0, 1.0 - 4.0 * len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) / greatest(1, len(coalesce(text, '')))) AS quality,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS sz, 2.0 * sum(size) AS cap, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w FROM d GROUP BY source),
t AS (SELECT 1.5 * sum(sz) AS total, sum(w) AS ws FROM s),
r AS (SELECT *, row_number() OVER o AS k, sum(cap) OVER o - cap AS caps, sum(w) OVER o - w AS cw FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
l AS (SELECT (total - caps) / (ws - cw) AS lam FROM r, t WHERE (total - caps) / (ws - cw) * w <= cap ORDER BY k LIMIT 1),
g AS (SELECT source, sz, CASE WHEN lam * w > cap THEN cap ELSE lam * w END AS target FROM s, l),
e AS (SELECT *, CASE WHEN sz > 0 THEN floor(target / sz)::BIGINT ELSE 0 END AS epochs FROM g),
b AS (SELECT *, floor(target - epochs * sz + 0.5)::BIGINT AS rest FROM e),
k AS (SELECT d.*, sz, target, epochs, rest, -ln(u) / quality AS key FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id) - size AS before FROM k)
SELECT doc_id, size, sz AS source_size, target::DOUBLE AS target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c
"""


def quality_weight(text: Column) -> Column:
    """1 for a text without symbols, down to 0.1 where a quarter of its characters are symbols."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]++", ""))
    return F.lit(0.1) + F.lit(0.9) * F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(4.0) * symbols / F.greatest(F.lit(1), F.length(t)))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / w with u in (0, 1) from 52 bits of the id's md5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), which has a row per source."""
    placed = dense_numbers(sources.withColumn(f"{OWN}none", F.col("source").isNull()), [], [f"{OWN}none", "source"], f"{OWN}place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(f"{OWN}place", F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(placed.withColumn("weight", weight).drop(f"{OWN}none", f"{OWN}place"), "sources")
    cap, level = F.lit(float(most)) * F.col("source_size"), None
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        capped = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        seen = ranked.agg(F.sum(F.when(capped, cap).otherwise(0.0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weights")).first()
        if not seen["weights"]:
            level = level or 0.0
            break
        last, level = level, (total - seen["full"]) / seen["weights"]
        if level == last:
            break
    return ranked.withColumn("target", F.when(F.lit(level) * F.col("weight") > cap, cap).otherwise(F.lit(level) * F.col("weight")))


def _range(at: Column, low: Column, high: Column) -> Column:
    """Which of ``RANGES`` even ranges from low to high a row lies in, by the first of key, id and hash that the ends differ in."""
    of = lambda x, part: x[part].cast("double")
    share = lambda part: F.coalesce(F.try_divide(of(at, part) - of(low, part), of(high, part) - of(low, part)), F.lit(0.0))
    level = F.when(low["key"] < high["key"], share("key")).when(low["id"] < high["id"], share("id")).when(low["hash"] < high["hash"], share("hash")).otherwise(F.lit(0.0))
    return F.when(at == high, F.lit(RANGES - 1)).when(at == low, F.lit(0)).otherwise(F.least(F.floor(level * RANGES), F.lit(RANGES - 1))).cast("int")


def narrowed(rows: DataFrame, goals: DataFrame, held: int = HELD) -> DataFrame:
    """(of, rest, before, low, high): for each source, the ends of a range of at most ``held`` rows, or of rows all alike, that its cut lies in, and the words before it."""
    ends = rows.where("size > 0").groupBy("source").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
    state = goals.where("rest > 0").select(F.col("source").alias("of"), "rest").join(sized(materialize(ends, "mix-ends"), 5), F.col("of").eqNullSafe(F.col("source"))).drop("source")
    state, done, turn = materialize(state.withColumn("before", F.lit(0).cast("long")), "mix-ranges-0"), None, 0
    while True:
        small = (F.col("n") <= held) | (F.col("low") == F.col("high"))
        final, turn = state.where(small), turn + 1
        done = final if done is None else done.unionByName(final)
        wide = materialize(state.where(~small), f"mix-wide-{turn}")
        if wide.isEmpty():
            return done.drop("n")
        inside = rows.where("size > 0").join(sized(wide, 5), F.col("source").eqNullSafe(F.col("of")) & (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high")))
        parts = inside.withColumn("range", _range(F.col("at"), F.col("low"), F.col("high")))
        parts = parts.groupBy("of", "rest", "before", "range").agg(F.sum("size").alias("words"), F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
        upto = F.col("before") + F.sum("words").over(W.partitionBy("of").orderBy("range"))
        parts = parts.withColumn("upto", upto).where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
        state = materialize(parts.select("of", "rest", "low", "high", "n", (F.col("upto") - F.col("words")).alias("before")), f"mix-ranges-{turn}")


def plan(rows: DataFrame, held: int = HELD, **shares) -> DataFrame:
    """For rows (source, size, at), at being a struct of key, id and hash: a row per source with its target, epochs and cut: what lies before ``cut_at`` is taken whole, and each of the rows there gives ``cut_words``."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, **shares).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = materialize(goals.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long")), "goals")
    at = materialize(narrowed(rows, goals, held), "cut-ranges")
    inside = rows.where("size > 0").join(sized(at, 5), F.col("source").eqNullSafe(F.col("of")) & (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high")))
    groups = inside.groupBy("of", "at", "before", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    reached = F.col("before") + F.sum("words").over(W.partitionBy("of").orderBy("at"))
    cut = groups.withColumn("reached", reached).where((F.col("reached") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("reached")))
    cut = cut.select("of", F.col("at").alias("cut_at"), F.floor((F.col("rest") - F.col("reached") + F.col("words")) / F.col("n")).cast("long").alias("cut_words"))
    joined = goals.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "epochs", "cut_at", "cut_words")
    return materialize(joined, "mix-plan")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Columns source, size and at, the place in the order of sampling, of a document."""
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    at = F.struct(sampling_key(doc_id, quality_weight(text)).alias("key"), F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("hash"))
    return [F.col(f"`{source_col}`").cast("string").alias("source"), F.size(words_of(text)).cast("long").alias("size"), at.alias("at")]


def _taken(row: Column, of: Column) -> Column:
    """Words that the mix takes of a document."""
    at, cut = row["at"], of["cut_at"]
    sampled = F.when(cut.isNull() | (at > cut), F.lit(0)).when(at < cut, row["size"]).otherwise(F.least(row["size"], of["cut_words"]))
    return (of["epochs"] * row["size"] + sampled).cast("long")


def with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows``, which has a struct ``__tm_row`` of ``sizes``, with the struct ``__tm_of`` of its source's plan."""
    of = planned.select(F.struct(*planned.columns).alias(f"{OWN}of"))
    return rows.join(sized(of, 5), F.col(f"{OWN}row.source").eqNullSafe(F.col(f"{OWN}of.source")))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """(id, size, source_size, target, taken) of every document."""
    rows = materialize(docs.select(F.col(id_col), F.struct(*sizes(docs, id_col, text_col, source_col)).alias(f"{OWN}row")), "mix-rows")
    planned = plan(rows.select(f"{OWN}row.*"), **shares)
    row, of = F.col(f"{OWN}row"), F.col(f"{OWN}of")
    return with_plan(rows, planned).select(id_col, row["size"].alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), _taken(row, of).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **shares) -> DataFrame:
    """The mix itself: a row per epoch of each document taken; the one that a target cuts keeps its first words, joined by blanks."""
    names = docs.columns
    rows = docs.withColumn(f"{OWN}row", F.struct(*sizes(docs, id_col, text_col, source_col)))
    planned = plan(materialize(rows.select(f"{OWN}row.*"), "mix-rows"), **shares)
    row, of, text = F.col(f"{OWN}row"), F.col(f"{OWN}of"), F.col(f"`{text_col}`")
    whole, words = F.col(f"{OWN}whole"), F.col(f"{OWN}words")
    mixed = with_plan(rows, planned).withColumn(f"{OWN}taken", _taken(row, of)).where(F.col(f"{OWN}taken") > 0)
    mixed = mixed.withColumn(f"{OWN}whole", F.floor(F.col(f"{OWN}taken") / row["size"]).cast("int")).withColumn(f"{OWN}words", (F.col(f"{OWN}taken") - F.col(f"{OWN}whole") * row["size"]).cast("int"))
    part = F.when(words > 0, F.array(F.array_join(F.slice(words_of(text), F.lit(1), words), " "))).otherwise(F.array().cast("array<string>"))
    mixed = mixed.withColumn(f"{OWN}text", F.explode(F.concat(F.array_repeat(text, whole), part)))
    made = {text_col: F.col(f"{OWN}text")} | ({length_col: F.length(f"{OWN}text").cast(docs.schema[length_col].dataType)} if length_col in names else {})
    return mixed.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))

"""Statistics of whole texts as Spark expressions: counts that quality rules and scores are made of.

Null texts count as empty; every statistic of an empty text is 0. Only built-in functions are used, no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, let, words_of

WINDOW = 8
#: Shares and means derived from the counts, each a double that is 0 for an empty text.
FEATURES = ("symbol_share", "upper_share", "exclaim_share", "digit_share", "stop_share", "repeat_share", "dup_line_share", "distinct_share", "word_length", "words_per_line", "log_words")


def _count(text: Column, characters: str) -> Column:
    """Characters of a class: what is left when all runs of others go."""
    return F.length(F.regexp_replace(text, f"[^{characters}]++", "")).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash comes twice or more, from the hashes of a text's windows in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(pairs, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda i: i.isNotNull())))
    covered = let(again, lambda at: F.aggregate(F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a struct column ``__tm_counts``; other columns, whatever their names, stay as they are."""
    w, h, t, lines = (f"{OWN}{x}" for x in ("words", "hashes", "t", "lines"))
    step = lambda a, n: let(a, lambda b: F.zip_with(b, F.slice(b, F.lit(n + 1), F.size(b)), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn(w, words_of(F.col(t)))
    df = df.withColumn(lines, F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashes = step(step(step(F.transform(w, lambda x: F.xxhash64(x)), 1), 2), 4)
    df = df.withColumn(h, F.when(F.size(w) >= WINDOW, F.slice(hashes, F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>")))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count(F.col(t), r"#*$%&|<>").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(h)).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _count(F.col(t), r"\p{Lu}").alias("n_upper"),
        _count(F.col(t), "!").alias("n_exclaim"),
        _count(F.col(t), "0-9").alias("n_digits"),
        _count(F.col(t), ".").alias("n_stops"),
    )
    return df.withColumn(f"{OWN}counts", counts).drop(w, h, t, lines)


def features(c: Column) -> dict[str, Column]:
    """The features of a struct of counts."""
    share = lambda a, b: F.coalesce(F.try_divide(c[a].cast("double"), c[b].cast("double")), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "exclaim_share": share("n_exclaim", "n_words"),
        "digit_share": share("n_digits", "word_chars"),
        "stop_share": share("n_stops", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "distinct_share": share("n_distinct", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "log_words": F.log1p(c["n_words"].cast("double")),
    }

"""Personal data: base patterns, and contextual patterns bootstrapped from what they find.

Base kinds are found by regular expressions, with positions: a text split at its matches gives the gaps, and running sums of
gap and match lengths give each place. The expressions are written so that a match can't start within a run that failed
(long runs cost linear time) and repeat possessively (no deep recursion), with the same matches as their plain forms.

Then the method: base spans are seed entities; each span, and each other token that looks like an identifier (letters,
digits and ``_./@+-``, ``ID_DIGITS`` digits or more), occurs in lexical patterns: its last word before, last two words before,
and last word before with first word after. Spark builds the graph of patterns and instances and scores it in rounds: a
pattern's score is the mean worth of its distinct instances (with a prior), an instance's worth is 1 for a seed, else the chance
that one of its good patterns is right (a score of ``GOOD`` or more). A pattern is supported by instances of a worth of
``CONFIDENCE`` or more, seeds or found ones, so what one pattern finds brings up others, round by round. Worths only ever rise;
rounds end when none rises by more than ``STEP``. Patterns with a score of ``CONFIDENCE`` and ``SUPPORT`` such instances mark
the other identifiers in them as spans of kind ``id``; base spans stay as they are.

Everything is DataFrame expressions. Texts are read once; the graph has only what stands next to spans, pre-aggregated by
(pattern, instance), so a word that stands before very many identifiers is many cells, each counted once, and a skewed side
of a join that adaptive execution splits. Words and identifiers of more than ``LONG`` characters stand in the graph as their
digest, so its rows are of bounded size; spans are of any length.

Defined results: a null or empty text has no span and the digest of an empty string; long texts with very many spans cost n
log n steps, and n^1.5 simple ones for running sums; repeated rows give equal spans each, and count once in the graph; an empty
table gives no rows; without seeds the method adds nothing; of overlapping spans the first names what ``redact`` puts there (of
equal places the first kind by name); other columns stay as they are in ``redact`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, let, materialize, read, sized, words_of

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. ``\\G`` (the end of the match before) or a look-behind holds a match to the start of a
#: run; for cards, which are whole runs of digits with single separators, the digit count is part of the pattern.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind's pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$"
TOKEN = r"(?<![A-Za-z0-9_./@+-])(?=[A-Za-z_./@+-]*+[0-9])[A-Za-z0-9_./@+-]{6,}+"
ID_DIGITS = 4
#: Characters of a word or identifier that stands in the graph as it is.
LONG = 64
PRIOR = 1.0
GOOD = 0.5
CONFIDENCE = 0.8
SUPPORT = 5
STEP = 0.01
#: Code points of the parts that a text is cut into before it is put together anew.
CHUNK = 4096
#: The last two words (or the one) of a text, and its first; a match starts where a word does, so long words cost linear time.
LAST_TWO = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$"
FIRST = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
EMPTY = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Exclusive prefix reductions of an array, by blocks of about the square root of its length (n^1.5 steps at most)."""

    def by_blocks(a: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / block).cast("int")), lambda b: F.aggregate(F.slice(a, b * block + 1, block), zero, merge))
        heads = let(blocks, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), zero, merge)))
        return let(heads, lambda h: F.transform(a, lambda _, i: F.aggregate(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block), F.get(h, F.floor(i / block).cast("int")), merge)))

    return let(values, by_blocks)


def matches(text: Column, pattern: str, hint: str) -> Column:
    """All matches: start, end (code points, end exclusive), value, and the words next to it: two before and one after."""

    def located(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        starts = F.zip_with(running(steps, F.lit(0), lambda a, b: a + b), gaps, lambda p, g: p + F.length(g))
        return let(starts, lambda s: F.transform(found, lambda m, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(m)).alias("end"), m.alias("value"), _context(F.regexp_extract(F.get(gaps, i), LAST_TWO, 0)).alias("before"), _context(F.regexp_extract(F.get(gaps, i + 1), FIRST, 0)).alias("after"))))

    none = F.array().cast(EMPTY)
    found = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: located(m, g))).otherwise(none))
    return F.when(text.rlike(hint), found).otherwise(none)


def _key(word: Column) -> Column:
    """A word as it stands in the graph."""
    return let(word, lambda w: F.when(F.length(w) > LONG, F.concat(F.lit("md5:"), F.md5(w.cast("binary")))).otherwise(w))


def _context(words: Column) -> Column:
    """A word or two in lower case, digits as 0."""
    return F.array_join(F.transform(words_of(F.regexp_replace(F.lower(words), "[0-9]", "0")), _key), " ")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        doubled = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + doubled(d.substr(F.length(d) - i, F.lit(1)).cast("int"), i))

    return let(_digits(value), total) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x["value"].rlike(IP),
    "card": lambda x: _luhn(x["value"]),
    "phone": lambda x: F.length(_digits(x["value"])).between(8, 15),
}


def _token(x: Column) -> Column:
    """A token without punctuation at its ends."""
    left = F.length(x["value"]) - F.length(F.ltrim(x["value"], F.lit("_./@+-")))
    core = F.btrim(x["value"], F.lit("_./@+-"))
    return F.struct((x["start"] + left).alias("start"), (x["start"] + left + F.length(core)).alias("end"), core.alias("value"), x["before"].alias("before"), x["after"].alias("after"))


def extract(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``__tm_found``: arrays of spans by base kind, and ``other``, tokens that overlap none of them."""
    t = f"{OWN}t"
    docs = docs.withColumn(t, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    for k in KINDS:  # columns, not a struct: Catalyst would compute a struct's field anew for each use
        docs = docs.withColumn(OWN + k, F.filter(matches(F.col(t), PATTERNS[k], HINTS[k]), VALID[k]))
    like_id = lambda x: F.length(_digits(x["value"])) >= ID_DIGITS
    tokens = F.transform(F.filter(matches(F.col(t), TOKEN, "[0-9]"), like_id), _token)
    for k in KINDS:
        tokens = _apart(tokens, F.col(OWN + k))
    docs = docs.withColumn(f"{OWN}other", tokens)
    return docs.withColumn(f"{OWN}found", F.struct(*[F.col(OWN + k).alias(k) for k in KINDS], F.col(f"{OWN}other").alias("other"))).drop(t, *[OWN + k for k in KINDS], f"{OWN}other")


def _apart(tokens: Column, spans: Column) -> Column:
    """The tokens that overlap no span; the members of either list are apart and in order.

    Both are sorted as one list, tokens by their ends and spans by their starts: a token's place there, less its number among
    the tokens, is how many spans start before it ends, and the last of those is the one that could reach into it.
    """

    def kept(ts: Column) -> Column:
        marks = F.concat(F.transform(spans, lambda y: F.struct(y["start"].alias("at"), F.lit(1).alias("span"), F.lit(0).alias("i"))), F.transform(ts, lambda x, i: F.struct(x["end"].alias("at"), F.lit(0).alias("span"), i.alias("i"))))
        before = F.filter(F.transform(F.sort_array(marks), lambda m, place: F.when(m["span"] == 0, place - m["i"])), lambda n: n.isNotNull())
        last = lambda ns, i: F.get(spans, F.get(ns, i) - 1)
        apart = let(before, lambda ns: F.filter(ts, lambda x, i: F.coalesce(last(ns, i)["end"] <= x["start"], F.lit(True))))
        return F.when((F.size(ts) == 0) | (F.size(spans) == 0), ts).otherwise(apart)

    return let(tokens, kept)


def contexts(x: Column) -> Column:
    """The lexical patterns of a span, from the words next to it."""
    two, first = x["before"], x["after"]
    last = F.substring_index(two, " ", -1)
    made = F.array(F.when(last != "", F.concat(F.lit("1 "), last)), F.when(two != last, F.concat(F.lit("2 "), two)), F.when((last != "") & (first != ""), F.concat(F.lit("3 "), last, F.lit(" _ "), first)))
    return F.filter(made, lambda p: p.isNotNull())


def graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, seed): a row per pattern and distinct value in it."""
    col = F.col(f"{OWN}found")
    cells = [F.transform(col[k], lambda x: F.struct(_key(F.lower(x["value"])).alias("instance"), contexts(x).alias("patterns"), F.lit(True).alias("seed"))) for k in KINDS]
    cells.append(F.transform(col["other"], lambda x: F.struct(_key(F.lower(x["value"])).alias("instance"), contexts(x).alias("patterns"), F.lit(False).alias("seed"))))
    rows = found.select(F.explode(F.flatten(F.array(*cells))).alias("x")).select("x.instance", "x.seed", F.explode("x.patterns").alias("pattern"))
    return rows.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def confident_patterns(found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, score, support) of the patterns that may mark unseen identifiers."""
    cells = materialize(graph(found), "pii-graph")
    # A pattern of fewer distinct instances than it needs support can take no part.
    sums = cells.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds"))
    sums = materialize(sums.where(F.col("n") >= support), "pii-sums")
    # The instances that have to be found; an instance that is a seed in any pattern is one in all.
    seeds = cells.where("seed").select("instance").distinct()
    unseen = cells.where("not seed").join(sized(materialize(seeds, "pii-seeds"), WIDTH), "instance", "left_anti")
    edges = materialize(unseen.join(sized(sums.select("pattern"), WIDTH), "pattern", "left_semi").select("pattern", "instance"), "pii-edges")
    worths, turn = None, 0
    while True:
        turn += 1
        scored = sums.withColumn("found", F.lit(0.0)).withColumn("trusted", F.lit(0).cast("long"))
        if worths is not None:
            more = edges.join(sized(worths, WIDTH), "instance").groupBy("pattern").agg(F.sum("worth").alias("found"), F.count(F.when(F.col("worth") >= confidence, 1)).alias("trusted"))
            scored = sums.join(sized(materialize(more, f"pii-more-{turn}"), WIDTH), "pattern", "left").fillna(0, ["found", "trusted"])
        patterns = scored.select("pattern", ((F.col("seeds") + F.col("found")) / (F.col("n") + PRIOR)).alias("score"), (F.col("seeds") + F.col("trusted")).alias("support"))
        patterns = materialize(patterns.where((F.col("support") >= support) & (F.col("score") >= GOOD)), f"pii-patterns-{turn}")
        new = edges.join(sized(patterns, WIDTH), "pattern").groupBy("instance").agg((F.lit(1.0) - F.exp(F.sum(F.ln(F.lit(1.0) - F.least("score", F.lit(0.99)))))).alias("worth"))
        before = F.lit(0.0)
        if worths is not None:
            new, before = new.join(sized(worths.withColumnRenamed("worth", "old"), WIDTH), "instance", "left"), F.coalesce("old", F.lit(0.0))
        worths = materialize(new.select("instance", "worth", (F.col("worth") - before).alias("rise")), f"pii-worths-{turn}")
        if (worths.agg(F.max("rise")).first()[0] or 0.0) <= STEP:
            return patterns.where(F.col("score") >= confidence)
        worths = worths.drop("rise")


#: Rows of the graph's tables, with a pattern of three bounded words at most, as multiples of a narrow row.
WIDTH = 5


def discovered(found: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """(key, spans): identifiers that confident patterns mark, in order."""
    tokens = found.where(F.size(f"{OWN}found.other") > 0).select(F.col(key), F.explode(f"{OWN}found.other").alias("x"))
    marked = tokens.select(key, F.struct("x.start", "x.end").alias("span"), F.explode(contexts(F.col("x"))).alias("pattern")).join(sized(patterns.select("pattern"), WIDTH), "pattern", "left_semi")
    return marked.groupBy(key).agg(F.sort_array(F.collect_set("span")).alias(f"{OWN}ids"))


def spans_of(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``__tm_base`` and ``__tm_spans``: arrays of (kind, start, end), base spans and all, by kind as listed and then by start, ``id`` last."""
    uid = f"{OWN}uid"
    found = extract(docs.withColumn(uid, F.monotonically_increasing_id()), text_col)
    found = materialize(found if keep_text else found.drop(text_col), "pii-found")
    narrow = found.select(uid, f"{OWN}found")
    ids = materialize(discovered(narrow, confident_patterns(narrow), uid), "pii-ids")
    col = F.col(f"{OWN}found")
    span = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.flatten(F.array(*[F.transform(col[k], span(k)) for k in KINDS]))
    extra = F.coalesce(F.transform(f"{OWN}ids", span("id")), F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return found.join(sized(ids, 10), uid, "left").withColumn(f"{OWN}base", base).withColumn(f"{OWN}spans", F.concat(base, extra)).drop(uid, f"{OWN}found", f"{OWN}ids")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first names the kind."""
    names, t = docs.columns, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = spans_of(docs, text_col)

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """Code points a to b of the text, from its parts; as they have a fixed length, no cut reads more than two of them besides its own."""
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        within = F.substring(F.get(parts, first), a % CHUNK + 1, b - a)
        across = F.concat(F.substring(F.get(parts, first), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.coalesce(F.substring(F.get(parts, last), F.lit(1), b % CHUNK), F.lit("")))
        return F.when(b <= a, F.lit("")).when(first == last, within).otherwise(across)

    def replaced(parts: Column, s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        piece = lambda x, e: F.when(x["start"] >= e, F.concat(cut(parts, e, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(F.zip_with(s, ends, piece), ""), let(last, lambda n: cut(parts, n, F.length(t))))

    ordered = F.sort_array(F.transform(f"{OWN}spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    parts = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}+"), 0)
    clean = F.when(F.size(f"{OWN}spans") > 0, let(parts, lambda p: let(ordered, lambda s: replaced(p, s)))).otherwise(F.col(f"`{text_col}`"))
    marked = marked.withColumn(f"{OWN}text", clean)
    made = {text_col: F.col(f"{OWN}text")} | ({length_col: F.coalesce(F.when(F.size(f"{OWN}spans") > 0, F.length(f"{OWN}text")).cast(docs.schema[length_col].dataType), F.col(f"`{length_col}`"))} if length_col in names else {})
    return marked.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_of(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter(f"{OWN}base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col(f"{OWN}base")).cast("binary"), 256).alias("base_sha256"), listed(F.col(f"{OWN}spans")).alias("spans"))

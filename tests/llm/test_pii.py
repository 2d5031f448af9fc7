import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tidemark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "plain", "a@b.c_d@e.f and a@b.com-x@y.com x@y .@a.b", "é mail jo.e+x@mail7.example.com, 😀 q@q.qq.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.003.255 1.1.1.256 12.34.56.78.90", "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111112 41111111111111111111 1 23  4111111111111111",
    "+1 (017) 555-7713 rest +123 +49(0)30.123456- +1234567890123456 ++1 555 555 5555+1 234 5678", "4111 1111 1111 1111 5500 0000 0000 0004", "a" * 4000 + "@" + "1" * 4000 + " " + "1 " * 60000, "x@y.z " * 3000, "1.1.1.1 " * 3000 + "+1 555 5555 5," * 2000, "9@9.9.9.9 9.9.9.9@x.y",
]


def rows_of(spark, docs):
    listed = pii.spans_of(docs)
    return {r.doc_id: r for r in listed.collect()}


def test_base_spans_against_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    for i, r in rows_of(spark, docs).items():
        assert [tuple(x) for x in r["__tm_base"]] == brute(TEXTS[i]), i
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "plain"
    assert clean[4] == "é mail [EMAIL], 😀 [EMAIL]."
    assert clean[10] == "[EMAIL] " * 3000
    assert clean[6].startswith("[CARD] and 4111-1111-1111-1111 4111111111111112") and clean[6].endswith("[CARD]") and pii.redact(docs).columns == docs.columns


def test_query_digest(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.query(spark, str(tmp_path)).collect():
        joined = ",".join(":".join(map(str, x)) for x in brute(TEXTS[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in brute(TEXTS[r.doc_id])) for x in PLAIN]


def test_bootstrapped_patterns(spark):
    """Addresses after "reach me" are seeds of a pattern that finds member numbers there; "order no" has no seed."""
    texts = [f"text {i} you may reach me u{i}@mail.example.org at noon" for i in range(12)]
    texts += ["then reach me KX-4471-9920 at noon", "the order no 5512-8871 at noon", "see 20240117 for more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id = 12"))
    found = pii.spans_of(docs).where("doc_id >= 12").orderBy("doc_id").collect()
    ids = [[tuple(x) for x in r["__tm_spans"] if x.kind == "id"] for r in found]
    at = texts[12].index("KX")
    assert ids == [[("id", at, at + 12)], [("id", at, at + 12)], [], []]
    assert pii.redact(docs).where("doc_id = 12").first().text == "then reach me [ID] at noon"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert pii.spans_of(docs).count() == 0 and pii.redact(docs).count() == 0
    long = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("12,34 "), 200000).alias("text"), F.lit(7).alias("n_chars"))
    assert pii.redact(long).first().n_chars == 7


def brute_graph(cells, confidence=0.8, support=5):
    """Scores of the graph by plain loops; cells: (pattern, instance, seed)."""
    seeds = {i for _, i, seed in cells if seed}
    of = {}
    for p, i, _ in cells:
        of.setdefault(p, set()).add(i)
    worth = {i: 1.0 if i in seeds else 0.0 for _, i, _ in cells}
    while True:
        score = {p: sum(worth[i] for i in x) / (len(x) + 1) for p, x in of.items() if sum(worth[i] >= confidence for i in x) >= support}
        good = {p: s for p, s in score.items() if s >= 0.5}
        new = {}
        for i in worth:
            miss = 1.0
            for p, s in good.items():
                miss *= 1 - min(s, 0.99) if i in of[p] else 1
            new[i] = 1.0 if i in seeds else 1 - miss
        rise = max((new[i] - worth[i] for i in worth), default=0)
        worth = new
        if rise <= 0.01:
            return {p: s for p, s in good.items() if s >= confidence}


def test_graph_against_brute_force(spark):
    r = random.Random(3)
    words = ["call", "mail", "write", "account", "order", "member"]
    texts = []
    for i in range(400):
        w = r.choice(words)
        value = f"u{i % 90}@mail.example.org" if r.random() < {"call": 0.9, "mail": 0.8, "write": 0.55}.get(w, 0.02) else f"K-{r.randint(1000, 1060)}"
        texts.append(f"please {w} {value} {r.choice(['soon', 'now'])}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.extract(docs)
    cells = [tuple(x) for x in pii.graph(found).collect()]
    want = brute_graph(cells)
    got = {x.pattern: x.score for x in pii.confident_patterns(found).collect()}
    assert got.keys() == want.keys() and len(want) > 3
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_found_identifiers_bring_up_other_patterns(spark):
    """"customer account" stands before no base kind, only before numbers that "reach me" has found."""
    texts = [f"text {i} you may reach me u{i}@mail.example.org at noon" for i in range(16)]
    texts += [f"then reach me KX-44{i:02}-9920 at noon" for i in range(8)]
    texts += [f"of customer account KX-44{i:02}-9920 as agreed" for i in range(8)]
    texts += ["of customer account ZZ-7781-0031 as agreed", "the order no 5512-8871 at once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.doc_id: [tuple(x) for x in r["__tm_spans"] if x.kind == "id"] for r in pii.spans_of(docs).collect()}
    for i, text in enumerate(texts):
        at = text.find("KX-") if "KX-" in text else text.find("ZZ-")
        assert ids[i] == ([("id", at, at + 12)] if at >= 0 else []), text


def test_identifiers_and_words_of_any_length(spark):
    long = "A1234" + "x" * 5000
    word = "w" * 3000
    texts = [f"{word} u{i}@mail.example.org at noon" for i in range(8)] + [f"{word} {long} at noon", "w" * 2999 + "v 12345678 none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.doc_id: [tuple(x) for x in r["__tm_spans"] if x.kind == "id"] for r in pii.spans_of(docs).collect()}
    assert ids[8] == [("id", 3001, 3001 + len(long))] and ids[9] == [] and ids[0] == []


def test_tokens_apart_from_spans(spark):
    texts = ["x12345@a.bc K-12345 1.2.3.4 1.2.3.4x9999 +1 555 555 5555 id77777", "4111 1111 1111 1111 K99999 a1234567@b.c d1234", "none 12345 at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.extract(docs).select("doc_id", "__tm_found.other").collect():
        text = texts[r.doc_id]
        base = [(a, b) for _, a, b in brute(text)]
        tokens = [(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9_./@+-])[A-Za-z0-9_./@+-]{6,}", text) if len(re.findall("[0-9]", m[0])) >= 4]
        tokens = [(a + len(text[a:b]) - len(text[a:b].lstrip("_./@+-")), a + len(text[a:b].rstrip("_./@+-"))) for a, b in tokens]
        assert [(x.start, x.end) for x in r.other] == [(a, b) for a, b in tokens if not any(c < b and a < d for c, d in base)]


def test_very_many_spans_in_one_text(spark):
    """A text of 5 MB with 100,000 spans."""
    text = "é" + "some words here x@y.example.org and\n no 12345678 more 😀 " * 100_000
    docs = spark.createDataFrame([(1, text, 1)], "doc_id long, text string, n_chars long")
    began = time.time()
    row = pii.redact(docs).first()
    assert row.text == text.replace("x@y.example.org", "[EMAIL]") and row.n_chars == len(row.text)
    assert time.time() - began < 240  # about 20 s on an idle box

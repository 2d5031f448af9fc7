import base64
import gzip
import hashlib
import io

from tidemark.llm import warc

PAGES = [(5, "http://a/\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://b", None), (7, "http://c", ""), (3, "http://d", "<p>é</p>"), (None, "http://e", "<p>é</p>"), (3, None, "<p>é</p>"), (1, "http://f", "x" * 3_000_000), (2, "http://g", "WARC/1.1\r\n\r\n\r\n")]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, file string").coalesce(2)
    out = f"file://{tmp_path}/w"
    files = warc.deduplicate(pages, out)
    rows = warc.read_archives(files, f"{out}/deduplicated").collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        match = [p for p in PAGES if p[0] == r.page_id]
        raw = (match[0][2] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.payload == (raw if r.record_type == "response" else None)
    kinds = sorted((r.page_id if r.page_id is not None else 10**9, r.record_type, r.refers_to or 0) for r in rows)
    assert kinds == [(1, "response", 0), (2, "response", 0), (3, "response", 0), (3, "revisit", 3), (3, "revisit", 3), (5, "revisit", 3), (7, "response", 0), (9, "revisit", 7), (10**9, "revisit", 3)]
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w" / "deduplicated").glob("*.gz")))
    assert whole.count(b"WARC-Type: ") == len(PAGES) and b"WARC-Target-URI: http://a/%0D%0AX: y\r\n" in whole
    assert whole.count(b"<p>\xc3\xa9</p>") == 1 and b"WARC-Refers-To: <urn:uuid:" in whole
    heads = [warc.parse(m)[0] for f in (tmp_path / "w" / "deduplicated").glob("*.gz") for m in warc.members(io.BytesIO(f.read_bytes()))]
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(PAGES)  # rows repeated with one id and url too
    for h in heads:
        if h["warc-type"] == "revisit":
            to = ids[h["warc-refers-to"]]
            assert h["warc-refers-to"] != h["warc-record-id"] and to["warc-type"] == "response" and to["warc-payload-digest"] == h["warc-payload-digest"]
    left = warc.resolve(warc.materialize(warc.write_archives(pages, f"{out}/again"), "t"), min_bytes=1)
    assert left.where("page_id in (7, 9) and record_type = 'response'").count() == 2
    assert warc.read_archives(warc.deduplicate(pages.limit(0), f"{out}/none"), f"{out}/none/deduplicated").count() == 0


def test_a_task_that_runs_again_replaces_its_archive(tmp_path):
    for _ in range(2):
        archive = warc._Archive(f"file://{tmp_path}", "part-000000.warc.gz")
        archive.add(b"the same bytes")
        archive.close()
    assert [f.read_bytes() for f in tmp_path.glob("*.gz")] == [b"the same bytes"] and not list((tmp_path / "_temporary").iterdir())


def test_members_and_parse():
    stream = io.BytesIO(gzip.compress(b"one") + gzip.compress(b"") + gzip.compress(b"three" * 100000))
    assert [len(m) for m in warc.members(stream, 7)] == [3, 0, 500000]
    fields, block = warc.parse(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert fields["warc-type"] == "x" and block == b"abc"

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import gif


def bitwise_decode(data: bytes, size: int) -> bytes:
    """A plain decoder, one code at a time."""
    clear, out, pos, width = 1 << size, b"", 0, size + 1
    table, prev = None, None
    while True:
        code = sum(((data[(pos + i) // 8] >> ((pos + i) % 8)) & 1) << i for i in range(width))
        pos += width
        if code == clear:
            table, prev, width = {i: bytes([i]) for i in range(clear)}, None, size + 1
            n = clear + 2
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code in table else prev + prev[:1]
        if prev is not None and n < 4096:
            table[n] = prev + entry[:1]
            n += 1
            if n == 1 << width and width < 12:
                width += 1
        out, prev = out + entry, entry


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000, 40000])
@pytest.mark.parametrize("kind", ["same", "random", "text"])
def test_lzw_round_trip(n, kind):
    r = random.Random(n)
    data = {"same": b"a" * n, "random": r.randbytes(n), "text": (b"the quick brown fox " * (n // 20 + 1))[:n]}[kind]
    stream = gif.lzw_encode(data)
    assert bitwise_decode(stream, 8) == data
    assert gif.lzw_decode(stream, 8, n) == data


@pytest.mark.parametrize("size", [2, 3, 7])
def test_fewer_colours(size):
    r = random.Random(size)
    data = bytes(r.randrange(1 << size) for _ in range(9000))
    stream = gif.lzw_encode(data, size)
    assert bitwise_decode(stream, size) == data == gif.lzw_decode(stream, size, len(data))


def test_deferred_clear_is_read():
    """A stream that goes on with 12-bit codes after the table is full."""
    r = random.Random(1)
    data = r.randbytes(9000)
    codes, bits, width, n = [256], [], 9, 258
    for i, c in enumerate([256, *data, 257]):
        bits += [(c >> k) & 1 for k in range(width)]
        if i >= 1:
            n += i >= 2
            if n == 1 << width and width < 12 and n <= 4095:
                width += 1
            n = min(n, 4096)
    assert codes
    stream = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    assert gif.lzw_decode(stream, 8, len(data)) == data


def test_disposal_and_transparency():
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 255, 0)
    u16 = lambda x: x.to_bytes(2, "little")

    def frame(values, disposal, transparent=None, left=0):
        samples = bytes(values)
        flags = disposal << 2 | (transparent is not None)
        return b"\x21\xf9\x04" + bytes([flags]) + u16(5) + bytes([transparent or 0, 0]) + b"\x2c" + u16(left) + u16(0) + u16(len(samples)) + u16(1) + b"\0\x08" + gif._blocks(gif.lzw_encode(samples))

    data = b"GIF89a" + u16(2) + u16(1) + b"\xf7\0\0" + palette.tobytes() + frame([1, 1], 1) + frame([0, 2], 3, transparent=0) + frame([2], 2) + frame([0], 1, left=1, transparent=0) + b"\x3b"
    shown = gif.decode_gif(data)
    seen = [["." if not p[3] else "rg"[int(p[1] > 0)] for p in f.canvas[0].tolist()] for f in shown]
    assert seen == [["r", "r"], ["r", "g"], ["g", "r"], [".", "r"]]
    assert [f.delay_cs for f in shown] == [5] * 4


def compose(w, h, parts):
    """A plain compositor, pixel by pixel; parts: (samples by row, left, top, disposal, transparent, palette). Gives the picture while each shows."""
    picture, out = {}, []
    for rows, left, top, disposal, transparent, palette in parts:
        before, area = dict(picture), set()
        for y, row in enumerate(rows):
            for x, v in enumerate(row):
                at = (left + x, top + y)
                if at[0] < w and at[1] < h:
                    area.add(at)
                    if v != transparent:
                        picture[at] = tuple(palette[v])
        out.append(dict(picture))
        if disposal == 2:
            picture = {k: v for k, v in picture.items() if k not in area}
        elif disposal == 3:
            picture = before
    return out


@pytest.mark.parametrize("seed", range(6))
def test_composition_against_a_plain_compositor(seed):
    r = random.Random(seed)
    u16 = lambda x: x.to_bytes(2, "little")
    w, h = r.randint(1, 9), r.randint(1, 9)
    colours = lambda: np.array([[r.randrange(256) for _ in range(3)] for _ in range(16)], np.uint8)
    shared, parts, data = colours(), [], b""
    for i in range(7):
        fw, fh, left, top = r.randint(1, w), r.randint(1, h), r.randrange(w), r.randrange(h)
        rows = [[r.randrange(16) for _ in range(fw)] for _ in range(fh)]
        disposal, transparent, local, laced = r.randrange(4), r.choice([None, r.randrange(16)]), r.random() < 0.5, r.random() < 0.5
        own = colours() if local else shared
        order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, fh, step)] if laced else range(fh)
        stream = gif.lzw_encode(bytes(v for y in order for v in rows[y]), 4)
        data += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + u16(i + 1) + bytes([transparent or 0, 0])
        data += b"\x2c" + u16(left) + u16(top) + u16(fw) + u16(fh) + bytes([(0x83 if local else 0) | (0x40 if laced else 0)]) + (own.tobytes() if local else b"") + b"\x04" + gif._blocks(stream)
        parts.append((rows, left, top, disposal, transparent, own.tolist()))
    blob = b"GIF89a" + u16(w) + u16(h) + b"\xf3\0\0" + shared.tobytes() + b"\x21\xfe\x02hi\0" + data + b"\x3b"
    *_, fault, frames = gif.decoded(blob)
    assert fault is None and len(frames) == 7
    start = 0
    for i, (f, seen) in enumerate(zip(frames, compose(w, h, parts), strict=True)):
        assert (f["frame"], f["start_cs"], f["delay_cs"], f["width"], f["height"]) == (i, start, i + 1, w, h)
        for c, name in enumerate(("red", "green", "blue")):
            want = [0] * 16
            for p in seen.values():
                want[p[c] // 16] += 1
            assert f[name] == want
        start += i + 1


def test_damaged_blobs(spark):
    whole = gif.encode_gif(gif.payload_frames(gif.pad(b"some bytes")))
    blobs = [None, b"", b"GIF89a", b"no gif at all", whole, whole[:-1], whole[:-60], whole[:40], whole[:6] + b"\xff" * 4 + whole[10:], whole.replace(b"\0\x08", b"\0\x0c", 1), b"GIF89a\1\0\1\0\0\0\0\x2c\0\0\0\0\1\0\1\0\0\x02\x02\xff\xff\0\x3b"]
    rng = random.Random(2)
    for _ in range(200):
        at = rng.randrange(len(whole))
        blobs.append(whole[:at] + bytes([rng.randrange(256)]) + whole[at + 1 :])
    docs = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(blobs)], "doc_id long, media binary")
    rows = {r.doc_id: r for r in gif.decode(docs).collect()}
    assert len(rows) == len(blobs)
    assert rows[0].error is None and rows[0].frames == [] and rows[0].media_bytes is None
    assert rows[4].error is None and len(rows[4].frames) == 1
    for i in (1, 2, 3, 5, 6, 7, 8, 9, 10):
        assert rows[i].error and rows[i].frames == [] and rows[i].payload_sha256 is None and rows[i].media_bytes == len(blobs[i]), i


def test_query_columns(spark, tmp_path):
    texts = [None, "", "a", "é" * 300, "x" * 576, "word " * 40000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in gif.query(spark, str(tmp_path)).collect()}
    import hashlib

    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(payload))
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert rows[i].tail_crc32 == zlib.crc32(payload[-32:])
        if len(payload) <= 576 * 64:  # one frame: the picture is the payload in grey
            bins = [0] * 16
            for x in payload:
                bins[x // 16] += 1
            assert rows[i].feature == "frames=1;cs=10;" + ";".join(f"{c}={','.join(map(str, bins))}" for c in "rgb")
    assert rows[6][1:] == rows[7][1:]
    media = gif.store(docs)
    assert gif.decode(gif.store(docs.limit(0))).count() == 0
    stored = gif.frames(gif.decode(media)).where("doc_id = 5").orderBy("frame").collect()
    assert len(stored) == -(-200448 // (576 * 64)) and stored[1].start_cs == 10
    assert sum(stored[0].red) == 576 * 64 == sum(stored[-1].blue)

"""GIF media columns: byte payloads stored losslessly as timed 8-bit frames, and decoding of any GIF with colour histograms.

``encode_gif`` writes frames as LZW code streams; ``decode_gif`` reads any GIF87a/89a: variable-width LZW codes with clear
and deferred clear codes, global and local palettes, interlacing, transparency and the four disposal rules. ``store`` makes
a media table of documents; ``decode`` reads it back once and gives, for each row, its timed frames with a histogram of
``BINS`` bins per colour channel of the picture as composed while the frame shows, beside digests of the samples; ``frames``
is the same as a row per frame.

Defined results: a null or empty text is 0 bytes and one block of 255s; texts of any length become as many frames as they
need; equal texts give equal bytes; repeated rows are stored each; a blob that is no whole GIF, or whose picture is larger than
``MOST_PIXELS``, has no frames, null digests of samples and its fault in ``error``; a null blob has no frames and no fault; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, read

SIDE = 24
BLOCK = SIDE * SIDE
#: Blocks of SIDE x SIDE samples in one frame at most.
FRAME_BLOCKS = 64
DELAY_CS = 10
#: Pixels of a picture that a worker composes at most; headers of damaged files can name far more.
MOST_PIXELS = 1 << 25
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
BINS = 16


@dataclass
class Frame:
    indices: np.ndarray  # height x width palette indices as coded
    palette: np.ndarray
    left: int
    top: int
    delay_cs: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray | None  # height x width x RGBA of the whole picture while this frame shows


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The LZW code stream of samples below ``1 << size``; the table is cleared when it is full."""
    clear, codes = 1 << size, []
    first, known = clear + 2, {}
    n, put, find = first, codes.append, known.get
    put(clear)
    rest = iter(samples)
    at = next(rest, None)
    if at is not None:
        for sample in rest:
            key = at << 8 | sample
            longer = find(key)
            if longer is None:
                put(at)
                known[key] = n
                n += 1
                at = sample
                if n == 4096:
                    put(clear)
                    known.clear()
                    n = first
            else:
                at = longer
        put(at)
    put(clear + 1)
    codes = np.array(codes, np.uint16)
    since = np.arange(len(codes)) - np.maximum.accumulate(np.where(np.concatenate(([True], codes[:-1] == clear)), np.arange(len(codes)), 0))
    since[0] = 0  # the first clear code; those that follow it count from 1, as after any other
    widths = _widths(since + (np.arange(len(codes)) > 0), clear)
    return _pack(codes, widths)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as a little-endian stream of bits."""
    ends = np.cumsum(widths)
    if widths.min() < 8:
        bits = (codes[:, None] >> np.arange(12, dtype=np.uint16)) & 1
        return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()
    starts = ends - widths
    out, at, value = np.zeros((int(ends[-1]) + 7) // 8 + 2, np.uint8), starts >> 3, codes.astype(np.uint32) << (starts & 7).astype(np.uint32)
    for k in range(3):  # a code of 8 bits or more starts in a byte of its own, so no index comes twice
        out[at + k] |= (value >> np.uint32(8 * k)).astype(np.uint8)
    return out[: (int(ends[-1]) + 7) // 8].tobytes()


def _widths(position: np.ndarray, clear: int) -> np.ndarray:
    """Bits of the code that comes ``position``-th (from 1) after a clear code."""
    return np.clip(np.floor(np.log2(clear + np.maximum(position, 1))).astype(np.int64) + 1, clear.bit_length(), 12)


def lzw_decode(data: bytes, size: int, n_samples: int) -> bytes:
    """The samples of an LZW code stream; ends at the end code, at ``n_samples`` or where the data end."""
    clear, end = 1 << size, (1 << size) + 1
    raw, n_bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32), 8 * len(data)
    widths = _widths(np.arange(1, 4097), clear)
    offsets = np.concatenate(([0], np.cumsum(widths)))
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    at, got, out = 0, 0, []
    table, previous, position = list(base), None, 0  # position: codes read since the clear code, 4096 at most
    while got < n_samples:
        n = int(np.searchsorted(offsets[position:] - offsets[position], n_bits - at, side="right")) - 1 if position < 4096 else 0
        if position < 4096:
            n = min(n, 4096 - position)
            where, width = at + offsets[position : position + n] - offsets[position], widths[position : position + n]
        else:
            n = min((n_bits - at) // 12, 4096)
            where, width = at + 12 * np.arange(n), np.full(n, 12)
        if n <= 0:
            break
        byte = where >> 3
        codes = ((raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)) >> (where & 7).astype(np.uint32)).astype(np.int64) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        use = int(stops[0]) if len(stops) else n
        run = codes[:use].tolist()
        if previous is None and run:
            if run[0] >= clear:
                raise ValueError("broken LZW stream")
            previous = base[run[0]]
            out.append(previous)
            del run[0]
        room = max(0, 4096 - len(table))
        learn, put = table.append, out.append
        for code in run[:room]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("broken LZW stream") from None
                entry = previous + previous[:1]
            learn(previous + entry[:1])
            put(entry)
            previous = entry
        if run[room:]:
            out += map(table.__getitem__, run[room:])
            previous = out[-1]
        got = sum(map(len, out)) if len(stops) else got
        if not len(stops):
            at, position = at + int(width.sum()), min(4096, position + n)
            got = sum(map(len, out))
            continue
        at += int(width[: use + 1].sum())
        if codes[use] == end:
            break
        table, previous, position = list(base), None, 0
    return b"".join(out)[:n_samples]


def _blocks(data: bytes) -> bytes:
    """GIF sub-blocks of at most 255 bytes, with the empty one that ends them."""
    whole = len(data) // 255
    head = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    parts = np.concatenate((np.full((whole, 1), 255, np.uint8), head), axis=1).tobytes()
    rest = data[whole * 255 :]
    return parts + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(frames: list[np.ndarray], palette: np.ndarray = GREY, delay_cs: int = DELAY_CS, disposal: int = 1) -> bytes:
    """Frames of 8-bit samples, placed at the upper left corner, as a GIF89a."""
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    u16 = lambda x: int(x).to_bytes(2, "little")
    out = [b"GIF89a", u16(width), u16(height), b"\xf7\0\0", palette.astype(np.uint8).tobytes()]
    for f in frames:
        out += [b"\x21\xf9\x04", bytes([disposal << 2]), u16(delay_cs), b"\0\0\x2c\0\0\0\0", u16(f.shape[1]), u16(f.shape[0]), b"\0\x08", _blocks(lzw_encode(f.tobytes()))]
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes, render: bool = True) -> list[Frame]:
    """The frames of a GIF; with ``render``, also the picture as composed by palettes, transparency and disposal. ValueError if it is none."""
    try:
        return _decode(data, render)
    except (IndexError, OverflowError) as broken:
        raise ValueError("the GIF ends early or is damaged") from broken


def _decode(data: bytes, render: bool) -> list[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    u16 = lambda i: int.from_bytes(data[i : i + 2], "little")
    width, height, flags, at = u16(6), u16(8), data[10], 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return table

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    if width * height > MOST_PIXELS:
        raise ValueError(f"a picture of {width} x {height} pixels; at most {MOST_PIXELS} are composed")
    shared, frames = colours(flags), []
    canvas = np.zeros((height, width, 4), np.uint8) if render else None
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind, at = data[at + 1], at + 2
            body = blocks()
            if kind == 0xF9:
                delay, disposal, transparent = int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown GIF block {data[at]:#x}")
        left, top, w, h, local = u16(at + 1), u16(at + 3), u16(at + 5), u16(at + 7), data[at + 9]
        at += 10
        palette = colours(local)
        palette = shared if palette is None else palette
        palette = GREY if palette is None else palette
        size, at = data[at], at + 1
        if not 1 <= size <= 8 or w * h > MOST_PIXELS:
            raise ValueError(f"a frame of {w} x {h} samples of {size} bits")
        samples = np.frombuffer(lzw_decode(blocks(), size, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if local & 0x40:
            rows = np.concatenate([np.arange(start, h, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(samples)
            straight[rows] = samples
            samples = straight
        shown = None
        if render:
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            seen = samples[: area.shape[0], : area.shape[1]]
            colour = palette[seen if len(palette) == 256 else np.minimum(seen, len(palette) - 1)]
            if transparent is None:
                area[..., :3], area[..., 3] = colour, 255
            else:
                opaque = seen != transparent
                area[opaque, :3], area[opaque, 3] = colour[opaque], 255
            shown = canvas.copy()
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
        frames.append(Frame(samples, palette, left, top, delay, disposal, transparent, shown))
        delay, disposal, transparent = 0, 0, None
    return frames


def canvas_histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of a composed picture by colour: BINS bins for each of red, green and blue; what is transparent doesn't count."""
    if canvas[..., 3].all():
        seen = canvas.reshape(-1, 4)
    else:
        seen = canvas[canvas[..., 3] > 0]
    return np.stack([np.bincount(seen[:, c] // (256 // BINS), minlength=BINS) for c in range(3)])


def pad(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % BLOCK if data else BLOCK)


def payload_frames(payload: bytes) -> list[np.ndarray]:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    step = SIDE * FRAME_BLOCKS
    return [samples[i : i + step] for i in range(0, len(samples), step)]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A GIF for the UTF-8 bytes of each text: (id, n_bytes, media)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            media = [encode_gif(payload_frames(pad(x))) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")), encode, f"{id_col} long, n_bytes long, media binary")


_FRAME = pa.struct([("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("red", "green", "blue"))])
_FRAMES = "frames array<struct<frame:int,start_cs:bigint,delay_cs:int,width:int,height:int,red:array<bigint>,green:array<bigint>,blue:array<bigint>>>"
_DECODED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"
_DECODED_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_FRAME))


def decoded(data: bytes | None) -> tuple:
    """What a blob decodes to: digests of the samples that its frames draw and of the blob, its fault, its timed frames."""
    if data is None:
        return (None, None, None, None, None, None, [])
    own = (len(data), hashlib.sha256(data).hexdigest())
    try:
        shown = decode_gif(data)
    except ValueError as fault:
        return (None, None, None, *own, str(fault), [])
    payload, start, rows = b"".join(f.indices.tobytes() for f in shown), 0, []
    for i, f in enumerate(shown):
        red, green, blue = canvas_histogram(f.canvas).tolist()
        rows.append({"frame": i, "start_cs": start, "delay_cs": f.delay_cs, "width": f.canvas.shape[1], "height": f.canvas.shape[0], "red": red, "green": green, "blue": blue})
        start += f.delay_cs
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, None, rows)


def decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per blob: the columns ``keep``, digests of its samples, and its timed frames with the histograms of the composed picture."""
    n = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(decoded, batch.column(n).to_pylist()), strict=True)) or [()] * len(_DECODED_TYPES)
            made = [pa.array(c, t) for c, t in zip(columns, _DECODED_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[id_col, *keep, *_DECODED_NAMES])

    schema = ", ".join([f"{id_col} long", *(f"{c} {media.schema[c].dataType.simpleString()}" for c in keep), _DECODED, _FRAMES])
    return map_rows(media.select(F.col(id_col).cast("long"), *keep, media_col), run, schema)


_DECODED_NAMES = [*(x.split()[0] for x in _DECODED.split(", ")), "frames"]


def frames(decoded_media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The table of timed frames: a row for each, with its number, times, size and colour histograms."""
    return decoded_media.select(id_col, F.explode("frames").alias("f")).select(id_col, "f.*")


def feature(listed: Column) -> Column:
    """Timed frames as a string: their number, the time that they take, and the pixels by colour, each frame's picture added."""
    zero = F.array_repeat(F.lit(0).cast("long"), BINS)
    total = lambda c: F.aggregate(listed, zero, lambda s, f: F.zip_with(s, f[c], lambda a, b: a + b))
    bins = [F.concat(F.lit(f";{c[0]}="), F.array_join(total(c).cast("array<string>"), ",")) for c in ("red", "green", "blue")]
    time = F.aggregate(listed, F.lit(0).cast("long"), lambda s, f: s + f["delay_cs"])
    return F.concat(F.lit("frames="), F.size(listed).cast("string"), F.lit(";cs="), time.cast("string"), *bins)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(store(read(spark, sf_dir, "documents").select("doc_id", "text")), "gif")
    stored = materialize(decode(media, keep=("n_bytes",)), "gif-frames")
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature(F.col("frames")).alias("feature"))

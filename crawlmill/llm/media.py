"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

Formats: P1-P6 (plain and raw, up to 8 bits) and uncompressed BMP of 8, 24 or 32 bits. A null or undecodable image has null features and
`error` says why; null and empty texts become one block of 64 zero bytes. Equal texts give equal rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, pieces, texts, written

WIDTH = 64
TILE = 32
#: Pixels that are added up or greyed at once.
BLOCK = 1 << 18
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def pad(text: bytes | None) -> bytes:
    """The text, with zero bytes up to a positive multiple of 64."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def encode_ppm(a: np.ndarray) -> bytes:
    """P5 of a (h, w) or P6 of a (h, w, 3) array of uint8."""
    return b"P%d\n%d %d\n255\n" % (5 if a.ndim == 2 else 6, a.shape[1], a.shape[0]) + a.tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """A bottom-up BMP: 8 bits with a grey palette of a (h, w), 24 bits of a (h, w, 3) array."""
    h, w = a.shape[:2]
    rows = a[::-1] if a.ndim == 2 else a[::-1, :, ::-1]
    line = w * (1 if a.ndim == 2 else 3)
    body = np.zeros((h, -(-line // 4) * 4), np.uint8)
    body[:, :line] = rows.reshape(h, line)
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if a.ndim == 2 else b""
    start = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if a.ndim == 2 else 24, 0, body.size, 2835, 2835, len(palette) // 4, 0) + palette + body.tobytes()


def _decode_netpbm(b: bytes) -> np.ndarray:
    kind = b[1] - 48
    at, head = 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = _TOKEN.match(b, at)
        if not m or len(m[1]) > 9:
            raise ValueError("short or unreadable header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = (*head, 1)[:3]
    if not (w > 0 and h > 0 and 0 < top < 256):
        raise ValueError("unsupported size or depth")
    depth = 3 if kind in (3, 6) else 1
    count, left = w * h * depth, len(b) - at
    # a plain sample takes two bytes at least, but for the last one
    if {1: count, 2: 2 * count - 1, 3: 2 * count - 1, 4: -(-w // 8) * h}.get(kind, count) > left:
        raise ValueError("short raster")
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", b[at:])[:count], np.uint8) - 48
    elif kind in (2, 3):
        samples = re.sub(rb"#[^\n]*", b"", b[at:]).split()[:count]
        if any(len(x) > 9 for x in samples):
            raise ValueError("sample above the maximum")
        flat = np.array([int(x) for x in samples], np.int64)
        if flat.size and flat.min() < 0:
            raise ValueError("negative sample")
    elif kind == 4:
        line = -(-w // 8)
        flat = np.unpackbits(np.frombuffer(b, np.uint8, count=h * line, offset=at + 1).reshape(h, line), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(b, np.uint8, count=count, offset=at + 1)
    if flat.size != count:
        raise ValueError("short raster")
    if flat.max() > top:
        raise ValueError("sample above the maximum")
    if kind in (1, 4):
        flat = (1 - flat) * 255
    elif top == 1:
        flat = flat * 255
    elif top < 255:
        flat = flat.astype(np.int64) * 255 // top
    return flat.astype(np.uint8).reshape((h, w, 3) if depth == 3 else (h, w))


def _decode_bmp(b: bytes) -> np.ndarray:
    start, head, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", b, 10)
    if packing or bits not in (8, 24, 32) or w <= 0 or not h:
        raise ValueError("unsupported BMP")
    line, each, high = -(-w * bits // 32) * 4, bits // 8, abs(h)
    if start + line * high > len(b):
        raise ValueError("short raster")
    rows = np.frombuffer(b, np.uint8, count=line * high, offset=start).reshape(high, line)[:, : w * each].reshape(high, w, each)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", b, 46)[0] or 256
        if used > 256 or 14 + head + 4 * used > len(b):
            raise ValueError("no palette")
        palette = np.frombuffer(b, np.uint8, count=used * 4, offset=14 + head).reshape(used, 4)[:, 2::-1]
        if rows.max() >= used:
            raise ValueError("index outside the palette")
        a = palette[rows[:, :, 0]]
        return a[:, :, 0].copy() if (palette == palette[:, :1]).all() else a
    return rows[:, :, 2::-1].copy()


def decode(b: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) array of uint8; ValueError if it is no image of the formats above.

    Sizes are held against the bytes before anything is read; samples above the maximum are refused."""
    try:
        if b[:1] == b"P" and b[1:2] in b"123456" and len(b) > 2:
            return _decode_netpbm(b)
        if b[:2] == b"BM":
            return _decode_bmp(b)
    except (struct.error, IndexError, ValueError, OverflowError) as e:
        raise ValueError(str(e)) from None
    raise ValueError("unknown format")


def grey(a: np.ndarray) -> np.ndarray:
    """(h, w) of uint8, in blocks of rows: whole numbers between take eight times the room."""
    if a.ndim == 2:
        return a
    out = np.empty(a.shape[:2], np.uint8)
    step = max(1, BLOCK // a.shape[1])
    for i in range(0, len(a), step):
        out[i : i + step] = a[i : i + step] @ np.array([299, 587, 114]) // 1000
    return out


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """The mean of each target cell's area, fractions of pixels included, from the integral image of a (H, W) array.

    The integral image is made in blocks of rows; of each only the rows that edges of cells lie in or next to are kept."""

    def edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * (size / parts)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    def cut(t: np.ndarray, low: np.ndarray, part: np.ndarray) -> np.ndarray:
        return t[low] * (1 - part[:, None]) + t[low + 1] * part[:, None]

    high, wide = a.shape
    low, part = edges(high, h)
    wanted = np.union1d(low, low + 1)
    rows, carry, step = np.zeros((len(wanted), wide + 1)), np.zeros(wide), max(1, BLOCK // wide)
    for i in range(0, high, step):
        sums = carry + np.cumsum(a[i : i + step], axis=0, dtype=np.float64)  # row k: all rows to i + k
        carry = sums[-1]
        here = np.flatnonzero((wanted > i) & (wanted <= i + step))
        rows[here, 1:] = np.cumsum(sums[wanted[here] - i - 1], axis=1)
    corner = cut(cut(rows, np.searchsorted(wanted, low), part).T, *edges(wide, w)).T
    return np.diff(np.diff(corner, axis=0), axis=1) * (h * w / a.size)


def difference_hash(a: np.ndarray) -> str:
    """16 hexadecimal digits: of an 8 by 9 resize, whether each cell is darker than its right neighbour."""
    small = np.round(area_resize(a, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(a: np.ndarray, size: int = TILE) -> bytes:
    """A size by size thumbnail as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(a, size, size)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as the samples of an image 64 wide.

    By its number of 64-byte lines modulo 3 it becomes a P6 of a third of the height, a P5 or a BMP of 8 bits."""
    bounded_batches(docs.sparkSession)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("media", dict)
        for batch in pieces(batches):
            media, sizes = [], []
            for t in texts(batch):
                a = np.frombuffer(pad(t), np.uint8).reshape(-1, WIDTH)
                kind = len(a) % 3
                media.append(encode_ppm(a.reshape(-1, WIDTH, 3) if kind == 0 else a) if kind < 2 else encode_bmp(a))
                sizes.append(len(t or b""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def kept(docs: DataFrame) -> DataFrame:
    """store, written to the shared folder as a table of media: what is read from it are the stored bytes."""
    return written(store(docs), "media")


def featured(media: DataFrame, key: str = "doc_id", tiles: bool = False) -> DataFrame:
    """media's key and n_bytes, with digests of the samples and of the stored form, the difference hash and, if asked for, the tile: the bytes of
    an NPY file of TILE by TILE grey samples."""
    bounded_batches(media.sparkSession)
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def row(b: bytes | None) -> tuple:
        if b is None:
            return (None,) * 7 + ("null", None)
        whole = len(b), hashlib.sha256(b).hexdigest()
        try:
            a = np.ascontiguousarray(decode(b))
        except ValueError as e:
            return None, None, None, *whole, None, None, str(e), None
        samples = a.reshape(-1)
        plain = grey(a)
        small = tile(plain)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:].tobytes()), *whole, difference_hash(plain), hashlib.sha256(small).hexdigest(), None, small

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("media", dict)
        for batch in pieces(batches):
            rows = list(zip(*map(row, texts(batch, "media")))) or [[]] * 9
            cols = [pa.array(c, k) for c, k in zip(rows, kinds)] + [pa.array(rows[8], pa.binary())] * tiles
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *cols], names + ["tile"] * tiles)

    schema = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string, error string" + ", tile binary" * tiles
    return media.select(key, "n_bytes", "media").mapInArrow(read, schema)

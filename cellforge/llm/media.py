"""Media columns: PNG images written and read with zlib and numpy, and hashes of their low frequencies.

Encoding and decoding work on the rows of an Arrow batch within tasks, one image at a time, so memory
is bounded by the largest single image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a row of pixels: 64 RGB pixels of 8 bits.
ROW = 192
CHANNELS = 3
LEVEL = 4
HASH_SIDE, SAMPLE_SIDE = 8, 32


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A PNG of 8-bit RGB whose samples are ``payload``, a positive multiple of ROW bytes; each row takes the filter (none, sub, up) with the least sum of differences."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub = x.copy()
    sub[:, CHANNELS:] -= x[:, :-CHANNELS]
    up = x.copy()
    up[1:] -= x[:-1]
    tried = np.stack([x, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    lines = np.empty((len(x), ROW + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(x))]
    header = struct.pack(">IIBBBBB", ROW // CHANNELS, len(x), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of filtered scan lines (a filter byte, then the row), for all five filters.

    Runs of rows that need no row above (none, sub) or only sums down the columns (up) are undone at
    once; average and Paeth go pixel by pixel, with all channels of a pixel together.
    """
    kinds, rows = lines[:, 0], lines[:, 1:]
    out = np.empty_like(rows)
    width = rows.shape[1]
    above = np.zeros(width, np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        kind, part = int(kinds[a]), rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part.reshape(b - a, -1, bpp), axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kind == 2:
            out[a:b] = np.cumsum(np.concatenate([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for r in range(a, b):
                up = (out[r - 1] if r else np.zeros(width, np.uint8)).astype(np.int16).reshape(-1, bpp)
                raw, line = rows[r].astype(np.int16).reshape(-1, bpp), np.zeros((width // bpp, bpp), np.int16)
                left = corner = np.zeros(bpp, np.int16)
                for p in range(width // bpp):
                    if kind == 3:
                        guess = (left + up[p]) // 2
                    else:
                        near = left + up[p] - corner
                        da, db, dc = abs(near - left), abs(near - up[p]), abs(near - corner)
                        guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up[p], corner))
                    left = line[p] = (raw[p] + guess) & 255
                    corner = up[p]
                out[r] = line.reshape(-1).astype(np.uint8)
        else:
            raise ValueError(f"unknown PNG filter {kind}")
        above = out[b - 1]
    return out


def decode(png: bytes) -> np.ndarray:
    """Samples (rows, row bytes) of a PNG of 8-bit grey, RGB or RGBA without interlacing; ValueError if a signature, checksum or size is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, data, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("cut off")
        (size,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body, check = png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(check) != 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if header is None or not ended:
        raise ValueError("no header or end")
    width, height, depth, colour, _, _, interlaced = header
    if depth != 8 or colour not in (0, 2, 6) or interlaced:
        raise ValueError("unsupported kind of PNG")
    bpp = {0: 1, 2: 3, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("wrong size")
    return unfilter(raw.reshape(height, -1), bpp)


def _cosines(n: int, k: int) -> np.ndarray:
    c = np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(k)[:, None] / (2 * n))
    return c * np.where(np.arange(k) == 0, np.sqrt(1 / n), np.sqrt(2 / n))[:, None]


BASIS = _cosines(SAMPLE_SIDE, HASH_SIDE)


def _cells(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of SAMPLE_SIDE cells over n samples, none of them empty."""
    a = np.arange(SAMPLE_SIDE) * n // SAMPLE_SIDE
    return a, np.maximum((np.arange(SAMPLE_SIDE) + 1) * n // SAMPLE_SIDE, a + 1)


def low_frequency_hash(samples: np.ndarray, bpp: int = CHANNELS) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine coefficients of the grey image exceed their median (the mean value is left out of it)."""
    grey = samples.reshape(len(samples), -1, bpp).sum(2, dtype=np.int64)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    total[1:, 1:] = grey.cumsum(0).cumsum(1)
    (ra, rb), (ca, cb) = _cells(grey.shape[0]), _cells(grey.shape[1])
    sums = total[rb][:, cb] - total[ra][:, cb] - total[rb][:, ca] + total[ra][:, ca]
    small = sums / ((rb - ra)[:, None] * (cb - ca)[None] * float(bpp))
    low = (BASIS @ small @ BASIS.T).round(6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW or (ROW if not data else 0)), len(data)


def _stored(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text):
        made = [padded(t) for t in batch.column(text).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], [*batch.schema.names, "n_bytes", "media"])


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` and the binary column ``media``, a PNG of the padded UTF-8 bytes of ``text`` (null: empty); columns of those names are replaced.

    An empty text becomes one row of blanks. Equal texts give equal images.
    """
    x = docs.drop("n_bytes", "media")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)
    return x.mapInArrow(lambda b: _stored(b, text), f"{names}, n_bytes bigint, media binary")


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        keep = [i for i, n in enumerate(batch.schema.names) if n != "media"]
        rows = []
        for png in batch.column("media").to_pylist():
            if png is None:
                rows.append((None,) * 6)
                continue
            samples = decode(png)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), low_frequency_hash(samples)))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], [*(batch.schema.names[i] for i in keep), *(f.split()[0] for f in FEATURES.split(", "))])


def media_features(images: DataFrame) -> DataFrame:
    """Reads column ``media`` back and puts its digests and hash in its place (null: null); a damaged image fails with ValueError."""
    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in images.schema if f.name != "media")
    return images.mapInArrow(_read, names + FEATURES)


def op6_media(docs: DataFrame) -> DataFrame:
    """Digests and hash of each row's image, written and read back. A null or empty text is one row of blanks; repeated rows have equal values; other columns are not read; no rows give no rows."""
    x = media_features(to_media(docs.select("doc_id", "text")).drop("text"))
    return x.select("doc_id", "n_bytes", *(F.col(f.split()[0]) for f in FEATURES.split(", ")))

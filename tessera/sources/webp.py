"""Lossless WebP (VP8L) from RGBA bytes: literal pixels under Huffman codes, no transforms.

The bit stream follows the public WebP lossless specification.  Code lengths are
limited to 15 by flattening the counts until the tree is shallow enough.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rgba import checked_range

#: Order in which the lengths of the code-length code are written: fixed by the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Pixels on a side of an image: the format has 14 bits for them.
MOST_SIDE = 1 << 14
#: Pixels whose bits are spread out at once.
STEP = 1 << 16


class Bits:
    """Least significant bit first."""

    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.held & 0xFF)
            self.held >>= 8
            self.n -= 8

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        """values[i] in widths[i] bits, one after another."""
        before = np.cumsum(widths) - widths
        shift = np.arange(int(widths.sum())) - np.repeat(before, widths)
        bits = np.concatenate([self.held >> np.arange(self.n) & 1, np.repeat(values, widths) >> shift & 1]).astype(np.uint8)
        whole = len(bits) // 8 * 8
        self.out += np.packbits(bits[:whole], bitorder="little").tobytes()
        self.held, self.n = sum(int(b) << k for k, b in enumerate(bits[whole:])), len(bits) - whole

    def done(self) -> bytes:
        return bytes(self.out + (bytes([self.held]) if self.n else b""))


def code_lengths(counts: np.ndarray, most: int) -> list[int]:
    """Huffman code lengths of at most `most` bits; 0 for symbols without a count."""
    used = [int(s) for s in np.flatnonzero(counts)]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
    if len(used) < 2:
        return out
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, d in depth.items():
                out[s] = d
            return out
        floor = floor * 2 if floor > 1 else max(2, int(counts.max()) >> most)


def canonical(lengths: list[int]) -> list[int]:
    """Canonical codes, bits reversed so that the first comes first."""
    out, code = [0] * len(lengths), 0
    for n in range(1, 16):
        for s, length in enumerate(lengths):
            if length == n:
                out[s] = int(format(code, f"0{n}b")[::-1], 2)
                code += 1
        code <<= 1
    return out


def write_code(bits: Bits, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """Writes a prefix code; returns (codes, lengths) to write symbols with, length 0 where only one symbol is."""
    used = np.flatnonzero(counts)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        symbol = int(used[0]) if len(used) else 0
        bits.put(1, 1)  # simple code
        bits.put(0, 1)  # of one symbol
        bits.put(int(symbol > 1), 1)
        bits.put(symbol, 8 if symbol > 1 else 1)
        return [0] * len(counts), [0] * len(counts)
    lengths = code_lengths(counts, 15)
    bits.put(0, 1)
    meta = code_lengths(np.bincount(lengths, minlength=19), 7)
    if sum(x > 0 for x in meta) == 1:  # a lone length would have no bits; give it a partner
        meta[0 if meta[0] == 0 else 1] = 1
    n = max(i for i, s in enumerate(LENGTH_ORDER) if meta[s]) + 1
    n = max(n, 4)
    bits.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        bits.put(meta[s], 3)
    bits.put(0, 1)  # all lengths follow
    codes = canonical(meta)
    for length in lengths:
        bits.put(codes[length], meta[length])
    return canonical(lengths), lengths


def encode(rgba: np.ndarray) -> bytes:
    """A WebP file of (height, width, 4) bytes."""
    height, width, _ = rgba.shape
    if not 1 <= width <= MOST_SIDE or not 1 <= height <= MOST_SIDE:
        raise ValueError(f"WebP images have 1 to {MOST_SIDE} pixels on a side, not {width} x {height}; extract_chunks gives larger ones in pieces")
    bits = Bits()
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(int((rgba[..., 3] != 255).any()), 1)
    bits.put(0, 3)
    bits.put(0, 1)  # no transform
    bits.put(0, 1)  # no colour cache
    bits.put(0, 1)  # one set of codes
    planes = [rgba[..., c].ravel() for c in (1, 0, 2, 3)]  # green, red, blue, alpha
    tables = [write_code(bits, np.bincount(p, minlength=256 + 24 if i == 0 else 256)) for i, p in enumerate(planes)]
    write_code(bits, np.zeros(40, int))  # distances: none
    tables = [[np.array(x, np.int64)[:256] for x in t] for t in tables]
    for at in range(0, height * width, STEP):
        codes, lengths = (np.stack([t[i][p[at : at + STEP]] for t, p in zip(tables, planes, strict=True)], axis=1).ravel() for i in (0, 1))
        bits.put_all(codes, lengths)
    body = bits.done()
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def rgba_of(pixels: np.ndarray, nodata: float | None, rescale: tuple[float, float] | None) -> np.ndarray:
    """(height, width, bands) samples as (height, width, 4) bytes, by the rules of `operators.rgba`."""
    bands = pixels.shape[2]
    if bands not in (1, 3, 4):
        raise ValueError(f"RGBA needs 1, 3 or 4 bands, not {bands}")
    checked_range(rescale)
    gap = np.isnan(pixels).any(axis=2)
    if nodata is not None:
        gap |= (pixels == np.float32(nodata)).all(axis=2)
    v = pixels.astype(np.float64)
    if rescale:
        n = min(bands, 3)
        v[..., :n] = (v[..., :n] - rescale[0]) / (rescale[1] - rescale[0]) * 255.0
    b = np.clip(np.floor(np.nan_to_num(v) + 0.5), 0, 255).astype(np.uint8)
    out = np.empty((*pixels.shape[:2], 4), np.uint8)
    out[..., :3] = b[..., :3] if bands > 1 else b
    out[..., 3] = b[..., 3] if bands == 4 else 255
    out[gap] = 0
    return out


def to_webp(rendered: DataFrame, nodata: float | None = None, rescale: tuple[float, float] | None = None) -> DataFrame:
    """(request, image) from rendered tiles (request, width, height, bands, pixels)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = []
            for w, h, n, p in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], b.column(4), strict=True):
                images.append(encode(rgba_of(np.asarray(p.values.to_numpy(zero_copy_only=False), np.float32).reshape(h, w, n), nodata, rescale)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(images, pa.binary())], names=["request", "image"])

    return rendered.select(F.col("request").cast("long"), "width", "height", "bands", "pixels").mapInArrow(work, "request long, image binary")

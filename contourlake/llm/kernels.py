"""Vectorised text kernels: words, hashes and n-grams of a whole Arrow batch at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits wide: a polynomial over
bytes modulo 2**64 with random byte values, then a full mix. Where equality decides a result, two
independent hashes (128 bits) are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240611).integers(0, 2**63, (2, 258), dtype=np.uint64)
_BYTE = [(_RANDOM[i, :256] << np.uint64(1)) ^ (_RANDOM[i, :256] >> np.uint64(31)) for i in (0, 1)]
_BASE = [int(_RANDOM[i, 256]) << 1 | 1 for i in (0, 1)]
_SALT = [_RANDOM[i, 257] for i in (0, 1)]
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as every batch needs them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base % 2**64, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(steps)
    return known[:n]


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Words:
    """The words of consecutive texts: byte spans, and for each text its range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i]:bounds[i + 1]

    def hashes(self, which: int = 0) -> np.ndarray:
        base = _BASE[which]
        inverse = pow(base, -1, 2**64)
        n = len(self.data)
        sums = _prefix(_BYTE[which][self.data] * powers(base, n))
        length = (self.end - self.start).astype(np.uint64)
        body = (sums[self.end] - sums[self.start]) * powers(inverse, n + 1)[self.start]
        return mix(body + length * _SALT[which])

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = GAP) -> Words:
    """Runs of bytes that ``apart`` doesn't name, within each text."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    gap = apart[data]
    inside = ~gap
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = gap[:-1] | edge[1:-1]
        after[:-1] = gap[1:] | edge[1:-1]
    start = np.flatnonzero(inside & before)
    return Words(data, start, np.flatnonzero(inside & after) + 1, np.searchsorted(start, offsets))


def grams(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of every n consecutive words; windows that leave a text are the caller's to drop."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = _BASE[which] ^ (n << 20)
    if n <= 8:
        out = h[:m].copy()
        for k in range(1, n):
            out = out * np.uint64(base) + h[k : k + m]
        return mix(out)
    sums = _prefix(h * powers(base, len(h)))
    return mix((sums[n:] - sums[:m]) * powers(pow(base, -1, 2**64), m))


def inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 windows of n words stay within one text."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    room = np.repeat(bounds[1:], np.diff(bounds))  # for each word, where its text ends
    return room[:m] - np.arange(m) >= n


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    width, out = 1, x
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column (null: empty) and where each text begins."""
    if column.null_count:
        column = column.fill_null("")
    kind = pa.large_string()
    column = column.cast(kind) if column.type != kind else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one piece holds about ``most`` bytes of text, or a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high

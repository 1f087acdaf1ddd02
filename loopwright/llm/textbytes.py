"""Vectorised work on the UTF-8 bytes of Arrow string columns: pieces of bounded size, words and span hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20_260_101)
#: A random odd-free value for each byte, and the base of the span polynomials.
VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
LOWER_VALUE = VALUE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
BASE = int(_RNG.integers(1, 2**63, dtype=np.uint64)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64, at least n of them."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Prefix sums over some bytes, from which the hash of any span is two look-ups."""

    def __init__(self, data: np.ndarray, value: np.ndarray = VALUE) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(value[data] * powers(BASE, n + 1)[:n], out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans [start, end): equal bytes give equal hashes wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and len + 1 offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(column) else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes come to about `most`; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that what is worked out for them stays small; an empty batch stays one."""
    for b in batches:
        for i in range(0, max(b.num_rows, 1), rows):
            yield b.slice(i, rows)


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row of each; words do not cross rows. `gap` marks the bytes that stand between words."""
    inside = ~gap[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    left = inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:n]
    right = inside.copy()
    right[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, sorted by row then hash; A-Z count as a-z.

    A row with fewer than k words has its whole word sequence as one shingle; one without words has none.
    """
    rows, hashes = [], []
    for i, j in runs(offsets):
        d, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, row = word_bounds(d, off)
        if not len(s):
            continue
        h = Spans(d, LOWER_VALUE).hash(s, e)
        count = np.bincount(row, minlength=j - i)
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        if len(h) >= k:
            g = np.zeros(len(h) - k + 1, dtype=np.uint64)
            for x in range(k):
                g = mix(g + h[x : x + len(g)] * np.uint64(2 * x + 3))
            whole = row[: len(g)] == row[k - 1 :]
            r, g = row[: len(g)][whole], g[whole]
        else:
            r, g = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            t = np.zeros(len(short), dtype=np.uint64)
            for x in range(k - 1):
                has = count[short] > x
                t[has] = mix(t[has] + h[first[short[has]] + x] * np.uint64(2 * x + 3))
            r, g = np.concatenate((r, short)), np.concatenate((g, mix(t + count[short].astype(np.uint64))))
        o = np.lexsort((g, r))
        r, g = r[o], g[o]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
        rows.append(r[new] + i)
        hashes.append(g[new])
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)

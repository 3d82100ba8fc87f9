"""Words of a batch of texts as arrays: no Python object for each word.

A batch's texts lie one after another in one byte buffer. Words are found by a table look-up and get a 64-bit
polynomial hash from one cumulative sum: h(word) = sum(T[byte_i] * P**i), taken from the difference of two prefix sums
and divided by P**start (P is odd, so it has an inverse modulo 2**64).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Bytes of text for which a worker keeps powers.
KEPT = 1 << 21
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (32, 9, 10, 11, 12, 13)


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse; a worker keeps them for up to KEPT bytes of text, longer texts get their own."""
    global _powers, _inverses
    if len(_powers) >= n:
        return _powers, _inverses
    n = 1 << (n - 1).bit_length()
    p, q = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
    if n <= KEPT:
        _powers, _inverses = p, q
    return p, q


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(column: pa.Array, most_bytes: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of a column with about most_bytes of text each, or one longer text."""
    offsets = buffer_of(column)[1]
    cuts, i = [], 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        cuts.append((i, j))
        i = j
    return cuts


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; bytes of other letters stay."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def spaces(buf: np.ndarray) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table[buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word reaches over the end of its text."""
    gap = spaces(buf)
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    first = first[: len(buf)]
    start = ~gap
    start[1:] &= gap[:-1] | first[1:]
    ends = ~gap
    ends[:-1] &= gap[1:] | first[1:]
    return np.flatnonzero(start), np.flatnonzero(ends) + 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice."""
    powers, inverses = _powers_for(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverses[starts]
    return mixed(h + (ends - starts).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct word shingles as 64-bit hashes; of a text with fewer words, the whole sequence as one; without words, none."""
    buf = lowered(buf)
    starts, ends = words(buf, offsets)
    codes = hashes(buf, starts, ends)
    at = np.searchsorted(starts, offsets)
    rolled = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for i in range(size):
        rolled = mixed(rolled ^ codes[i : len(codes) - size + 1 + i]) if len(rolled) else rolled
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(rolled[a : b - size + 1])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for c in codes[a:b]:
                h = mixed(h ^ c)
            out.append(mixed(h + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out

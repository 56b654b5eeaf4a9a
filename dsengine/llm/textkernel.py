"""Numpy helpers over the UTF-8 bytes of an Arrow text column: word bounds and
64-bit polynomial (Rabin-Karp) hashes, worked out for whole batches at once.

Hashes are sums of random byte codes times powers of an odd base modulo 2**64,
so the hash of any stretch is a difference of two prefix sums; a bijective
mixer spreads the result. Functions here hold no state but power tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE_BYTE = 0x9E3779B97F4A7C13  # 3 modulo 8
BASE_WORD = 0xD1B54A32D192ED0B  # 3 modulo 8

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: digits, a-z and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, PIECE + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = 1 << 20):
    """Row ranges of about ``size`` bytes, one row at least."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    ok = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = ok.copy()
    first[1:] &= ~ok[:-1] | edge[1:-1]
    last = ok.copy()
    last[:-1] &= ~ok[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, bounds)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, in pieces so that memory stays bounded."""
    out = np.empty(len(start), np.uint64)
    i, n = 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        if hi - lo > PIECE:  # one word longer than a piece
            out[i] = int.from_bytes(hashlib.blake2b(data[lo:hi].tobytes(), digest_size=8).digest(), "little")
        else:
            up, down = powers(BASE_BYTE, hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(CODES[data[lo:hi]] * up[:hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every stretch of ``width`` words within a row."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.flatnonzero(left >= width)
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), PIECE):
        part = at[lo:lo + PIECE]
        a, b = int(part[0]), int(part[-1]) + width
        up, down = powers(BASE_WORD, b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(hashes[a:b] * up[:b - a], out=sums[1:])
        out[lo:lo + PIECE] = mix((sums[part + width - a] - sums[part - a]) * down[part - a])
    return at, out

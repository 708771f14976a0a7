"""Vectorised word spans and Rabin-Karp hashes over the bytes of many documents at once.

All hashes are polynomial prefix sums modulo 2**64 with an odd (hence invertible) base over random
64-bit codes per byte, finished by a bit mixer; equal byte spans hash equally wherever they stand.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE_BYTES, BASE_WORDS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Word characters: anything but ASCII white space; digits, lower-case a-z and everything beyond ASCII.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64; kept and grown in each worker."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size, inv = max(n, 1 << 16) * 5 // 4, pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inv):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            tables.append(np.cumprod(x, dtype=np.uint64))
        _powers[base] = have = (tables[0], tables[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(codes: np.ndarray, base: int) -> np.ndarray:
    """P with P[j] - P[i] = sum of codes[t] * base**t for i <= t < j."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes) + 1)[0][: len(codes)], out=out[1:], dtype=np.uint64)
    return out


def between(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Unmixed hash of each span [start, end): the same for equal spans anywhere."""
    return (p[ends] - p[starts]) * powers(base, len(p))[1][starts]


def byte_prefix(buf: np.ndarray, second: bool = False) -> np.ndarray:
    return prefix((_CODES2 if second else _CODES)[buf], BASE_BYTES)


def word_spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the number of words before it (n+1 values)."""
    w = table[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    before &= ~edge[:-1]
    after &= ~edge[1:]
    starts = np.flatnonzero(w & ~before)
    return starts, np.flatnonzero(w & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = between(byte_prefix(buf), starts, ends, BASE_BYTES)
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(words: np.ndarray, k: int, base: int = BASE_WORDS) -> np.ndarray:
    """Rabin-Karp hash of every run of k words (len(words) - k + 1 values, runs across documents included)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    p = prefix(words, base)
    at = np.arange(len(words) - k + 1)
    return mix(between(p, at, at + k, base))


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Global start and document number of each run of k items that stays in one document; first: items before each document."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    return start, doc


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of n places that at least one [start, end) covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0

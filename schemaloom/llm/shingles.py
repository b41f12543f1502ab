"""Word shingles of whole texts as 64-bit numbers, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = np.random.default_rng(20_240_502).integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text (empty for null or blank texts).

    Words are hashed as polynomials over their bytes, from prefix sums; a text of fewer than five words
    is one shingle of its own kind.
    """
    parts = [(t or "").encode() for t in texts]
    edges = np.cumsum([0, *(len(p) + 1 for p in parts)])
    data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    blank = _SPACES[data]
    inside = np.concatenate([[False], ~blank]).astype(np.int8)
    turn = np.diff(inside)
    starts = np.flatnonzero(turn == 1)
    ends = np.flatnonzero(turn == -1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_BASE, len(data)))])
    back = _powers(pow(_BASE, -1, 1 << 64), len(data))
    words = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, edges)
    rows = max(0, len(words) - WORDS + 1)
    runs = np.zeros(rows, np.uint64)
    for k in range(WORDS):
        runs += words[k:k + rows] * _PLACES[k]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(runs[a:b - WORDS + 1]))
        elif b > a:
            few = np.append(words[a:b] * _PLACES[:b - a], _PLACES[WORDS:] * np.uint64(b - a))
            out.append(mix(few.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_number(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set: equal sets agree, others differ but for chance (2^-64 a pair)."""
    total = shingles.sum(dtype=np.uint64)
    odd = np.bitwise_xor.reduce(mix(shingles ^ _PLACES[0])) if len(shingles) else np.uint64(0)
    both = mix(np.array([total, odd, len(shingles)], np.uint64) * _PLACES[1:4])
    return int(mix(both.sum(dtype=np.uint64, keepdims=True)).astype(np.int64)[0])

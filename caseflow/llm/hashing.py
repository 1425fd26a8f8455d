"""Hashes of words and word windows, computed on whole arrays.

A text is taken as its words joined by single blanks. The hash of a stretch of bytes is a polynomial
over random byte values modulo 2**64, read off prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CHUNK = 1 << 19
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = 1 << int(n).bit_length()
        _powers[kind] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, base))), dtype=np.uint64)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each stretch raw[start:end], the starts ascending."""
    out = []
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, first + _CHUNK)))
        last = int(ends[at:to].max())
        n = int(last - first)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw[first:last]] * _power("up", _BASE, n)[:n], out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out.append((sums[e] - sums[s]) * _power("down", _UNBASE, n + 1)[s])
        at = to
    return mix(np.concatenate(out)) if out else np.empty(0, np.uint64)


def bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words joined by blanks, and where words start and end."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return data, np.empty(0, np.int64), np.empty(0, np.int64)
    blanks = np.flatnonzero(data == 32)
    return data, np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(data)]))


def windows(text: str, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words; of all words, if there are fewer; none without words."""
    data, starts, ends = bounds(b" ".join(text.encode("utf-8", "replace").split()))
    if not len(starts):
        return np.empty(0, np.uint64)
    span = min(width, len(starts))
    return stretches(data, starts[: len(starts) - span + 1], ends[span - 1 :])

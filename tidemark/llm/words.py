"""Whole-text word and window hashes, vectorised with numpy inside tasks.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. Hashes are 64-bit polynomial
hashes of whole words and of whole word windows, read off prefix sums, so that a text costs a
few array operations however long it is.
"""

from __future__ import annotations

import numpy as np

_BYTE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:] = base
        down[1:] = pow(int(base), -1, 1 << 64)
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 18:  # longer ones serve one text and go
            _powers[int(base)] = have
    return have


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word of ``data``, in order."""
    start, end = bounds(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _power(_BYTE, len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` consecutive words; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(_WORD, len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased; with fewer words, of all of them as one."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else words

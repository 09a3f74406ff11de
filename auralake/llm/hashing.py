"""Vectorised word and shingle hashing shared by the operators of this subpackage.

Everything here works on one text at a time and is called from inside Spark
tasks.  A word is a maximal run of bytes other than ASCII white space
(0x20, 0x09-0x0D) of the UTF-8 text; hashes are 64-bit and the same in every
process.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_WORD_BASE = U64(0x9E3779B97F4A7C15)
_SHINGLE_BASE = U64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_powers = np.ones(1, dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply) over an array."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers), 64), _WORD_BASE, dtype=U64))
    return _powers


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes of the text with A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end exclusive) of the words."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word."""
    if not len(starts):
        return np.empty(0, dtype=U64)
    data = np.frombuffer(raw, dtype=np.uint8).astype(U64) + U64(1)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    picked = data[at + np.repeat(starts, lengths)] * _powers_to(int(lengths.max()))[at]
    return mix(np.add.reduceat(picked, first))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, in text order; empty when there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=U64)
    total = np.zeros(count, dtype=U64)
    for j in range(n):
        total = total * _SHINGLE_BASE + words[j : j + count]
    return mix(total)


def text_words(text: str | None) -> np.ndarray:
    raw = lower_ascii(text)
    return word_hashes(raw, *word_bounds(raw))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text counts as one shingle of all its words."""
    words = text_words(text)
    if not len(words):
        return np.empty(0, dtype=U64)
    return np.unique(gram_hashes(words, min(n, len(words))))

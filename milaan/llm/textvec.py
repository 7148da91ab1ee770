"""Words, shingles and hashes of whole batches of UTF-8 text as numpy arrays; no Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64, which maps one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0..n-1, and the inverses, modulo 2^64."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for key, factor in (("up", BASE), ("down", INVERSE)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            _POWERS[key] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _word_lut() -> np.ndarray:
    """Lower-cases A-Z and keeps digits, letters and all bytes of other scripts; 0 for the rest."""
    lut = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            lut[b] = c
    return lut


WORD_BYTE = _word_lut()
# What tells apart the bytes of a word; a random number each, so that no two words add up alike.
BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
BYTE_CODE[0] = 0


@dataclass
class Words:
    doc: np.ndarray  # row of each word
    hash: np.ndarray
    start: np.ndarray  # byte positions
    end: np.ndarray
    first: np.ndarray  # of each row: its first word; one more entry than rows


def tokens(mapped: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes of one ``kind`` above 0, never across rows; ``mapped`` is what is hashed."""
    n, rows = len(mapped), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none, np.zeros(rows + 1, np.int64))
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    new[offsets[:-1][offsets[:-1] < n]] = True
    edge = np.flatnonzero(new)
    start, end = edge[:-1], edge[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[mapped] * up[:n], out=total[1:])
    hashes = mixed((total[end] - total[start]) * down[start])
    first = np.searchsorted(start, offsets).astype(np.int64)
    doc = np.repeat(np.arange(rows), np.diff(first))
    return Words(doc, hashes, start, end, first)


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    mapped = WORD_BYTE[raw]
    return tokens(mapped, (mapped > 0).view(np.uint8), offsets)


# Spaces and control signs part tokens; runs of signs are tokens of their own.
_KIND = np.where(WORD_BYTE > 0, 1, np.where(np.arange(256) > 32, 2, 0)).astype(np.uint8)
_KIND[127] = 0
_SHOWN = np.where(WORD_BYTE > 0, WORD_BYTE, np.arange(256)).astype(np.uint8)


def words_and_signs(raw: np.ndarray, offsets: np.ndarray) -> Words:
    return tokens(_SHOWN[raw], _KIND[raw], offsets)


def shingles(w: Words, k: int) -> np.ndarray:
    """The hash of the k words from each word on; only entries whose k words are in one row mean anything (``whole``)."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += w.hash[j : j + n] * np.uint64(pow(int(BASE), 2 * j, 1 << 64))
    return mixed(total + np.uint64(k))


def whole(w: Words, k: int) -> np.ndarray:
    n = max(0, len(w.hash) - k + 1)
    return w.doc[:n] == w.doc[k - 1 : k - 1 + n]


class Lookup:
    """Which of many numbers are in a sorted set: a bitmap of the low bits first, then a search for the few left."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[(self.keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def where(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions whose value is in the set, and which key it is."""
        at = np.flatnonzero(self.map[(values & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[key] == values[at]
        return at[same], key[same]

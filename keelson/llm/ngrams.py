"""Hashed n-grams of many texts at once, in numpy."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain, count

import numpy as np

from .common import WORD

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def bucket(hashed: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of mixed 32-bit hashes."""
    hashed = hashed ^ (hashed >> np.uint32(15))
    return ((hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)).astype(np.int32)


def char_ngrams(texts: list[str], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all texts end to end, and their number in each text."""
    units = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return _windows(units, lengths, n, bits)


def _windows(units: np.ndarray, lengths: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.maximum(lengths - n + 1, 0)
    if len(units) < n:
        return np.zeros(0, np.int32), made
    size = len(units) - n + 1
    hashed = np.full(size, np.uint32(n * 0x165667B1 & 0xFFFFFFFF))
    for k in range(n):
        hashed += units[k : size + k] * _MULTIPLIERS[k]
    if n > 1:  # windows that run into the next text go
        inside, ends = np.ones(size, bool), np.cumsum(lengths)
        for k in range(1, n):
            at = ends - k
            inside[at[(at >= 0) & (at < size)]] = False
        hashed = hashed[inside]
    return bucket(hashed, bits), made


class Words:
    """The words of many texts: ids (numbers of distinct words), counts for each text, and the distinct words."""

    def __init__(self, texts: list[str]):
        found = [WORD.findall(t) for t in texts]
        number: dict[str, int] = defaultdict(count().__next__)
        self.counts = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(self.counts.sum()))
        self.distinct = list(number)

    def sizes(self) -> np.ndarray:
        """Code points of each word in order."""
        return np.fromiter(map(len, self.distinct), np.int64, len(self.distinct))[self.ids] if len(self.ids) else self.ids

    def ngrams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in self.distinct), np.uint32, len(self.distinct))
        return _windows(hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint32), self.counts, n, bits)

    def repeated(self, n: int = 3) -> np.ndarray:
        """For each text its words in windows of n words that occur twice or more in it (exact, no hashing)."""
        total, texts = len(self.ids), len(self.counts)
        doc = np.repeat(np.arange(texts), self.counts)
        marked = np.zeros(total, bool)
        starts = np.arange(max(0, total - n + 1))
        starts = starts[doc[starts] == doc[starts + n - 1]] if len(starts) else starts
        if len(starts):
            key = self.ids[starts]
            for k in range(1, n):
                key = np.unique(key, return_inverse=True)[1] * len(self.distinct) + self.ids[starts + k]
            key = np.unique(key, return_inverse=True)[1] * texts + doc[starts]
            _, place, times = np.unique(key, return_inverse=True, return_counts=True)
            twice = starts[times[place] > 1]
            for k in range(n):
                marked[twice + k] = True
        return np.bincount(doc[marked], minlength=texts).astype(np.int64)

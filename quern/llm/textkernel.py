"""Vectorised text kernels: tokens and their hashes for a whole batch of texts at once.

A batch is encoded as one byte buffer. Token borders come from a byte-class
table, token hashes from differences of prefix sums of a polynomial modulo
2**64, so no Python code runs per token.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Byte classes: 0 space, 1 word (letters, digits, underscore, every byte of a non-ASCII character), 2 other.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1

#: For words split at white space only.
SPACES = (CLASSES != 0).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Tokens of a list of texts: ``hash``, ``start``, ``end`` (bytes), ``kind`` and ``doc`` of each, and ``first`` per text."""

    def __init__(self, texts: list[str], classes: np.ndarray = CLASSES):
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        self.bytes = data = np.frombuffer(b" ".join([*raw, b""]) or b"", np.uint8)
        kind = classes[data]
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        edges = np.concatenate([[0], change, [len(data)]]).astype(np.int64)
        start, end = edges[:-1], edges[1:]
        if len(data):
            full = kind[start] != 0
            start, end = start[full], end[full]
            self.kind = kind[start]
        else:
            start = end = np.zeros(0, np.int64)
            self.kind = np.zeros(0, np.uint8)
        self.start, self.end = start, end
        begins = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(start, begins)
        self.first[-1] = len(start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hash(data, start, end)

    @staticmethod
    def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64)
        powers = np.empty(n, np.uint64)
        powers[0], powers[1:] = 1, _BASE
        np.cumprod(powers, out=powers)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
        powers[0], powers[1:] = 1, _INVERSE
        np.cumprod(powers, out=powers)
        return mix((total[end] - total[start]) * powers[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the texts they lie in."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words[:m].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : m + k] + np.uint64(k))
    inside = doc[:m] == doc[n - 1 :]
    return out[inside], doc[:m][inside]

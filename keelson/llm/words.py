"""Words and word shingles of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, _U)


def _power(n: int) -> np.ndarray:
    """The first n powers of the base of word hashes."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _U(0x9E3779B97F4A7C15) | _U(1)), dtype=_U)
    return _powers[:n]


class Words:
    """Words of texts (UTF-8), A-Z lower-cased: ``hash`` of each and its text's number ``doc``.

    ``breaks`` tells which lower-cased bytes stand between words: [\\x20\\x09-\\x0D] if not given.
    """

    def __init__(self, texts: list[bytes], breaks: np.ndarray = _SPACE):
        data = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        self.data = data
        blank = breaks[data]
        edge = np.flatnonzero(np.diff(blank, prepend=True))  # a word starts, ends, starts, ...
        self.start, self.end = edge[::2], edge[1::2]
        self.n = len(texts)
        size = self.end - self.start
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))  # words of text i: first[i] to first[i + 1]
        if not len(size):
            self.hash = np.zeros(0, _U)
            return
        power = _power(int(size.max()))
        place = np.arange(len(data), dtype=np.int64)
        place -= _since(self.start, len(data))
        term = np.where(blank, _U(0), data.astype(_U) + _U(1))
        term *= power[np.minimum(np.where(blank, 0, place), len(power) - 1)]
        self.hash = mix(np.add.reduceat(term, self.start) + size.astype(_U))

    def shingles(self, k: int) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its k-word shingles; of fewer words, of all as one."""
        h, out = self.hash, []
        if len(h) >= k:
            rolled = h[:len(h) - k + 1] * _U(0xD6E8FEB86659FD93)
            for j in range(1, k):
                rolled = mix(rolled + h[j:len(h) - k + 1 + j] * _U(2 * j + 0xD6E8FEB86659FD93))
        else:
            rolled = h[:0]
        for a, z in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if z - a >= k:
                out.append(np.unique(rolled[a:z - k + 1]))
            elif z > a:
                few = np.full(1, z - a, _U)
                for i in range(a, z):
                    few = mix(few + h[i:i + 1])
                out.append(few)
            else:
                out.append(h[:0])
        return out


def _since(starts: np.ndarray, n: int) -> np.ndarray:
    """For each place the start of the word at or before it (0 before the first)."""
    mark = np.zeros(n, np.int64)
    mark[starts] = starts
    return np.maximum.accumulate(mark)

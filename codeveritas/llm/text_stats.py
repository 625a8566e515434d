"""Statistics of whole texts as bytes, a block of documents at a time."""

from __future__ import annotations

import numpy as np

from .qgrams import mix, pair

#: Bytes of white space in the word pattern, and counted symbols (fixed values).
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.array([b in SPACE for b in range(256)])
_IS_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
#: What each byte value adds to a hash of the string it stands in.
_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    step = base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
        step = step * step
    return out[:n]


class Hashes:
    """Hashes of any substring of a buffer, from prefix sums of a polynomial modulo 2 ** 64.

    Byte values enter through a random table, and the sum is mixed with the length at the end.
    """

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        with np.errstate(over="ignore"):
            terms = _SPREAD[buffer] * powers(n, _STEP)
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            self.down = powers(n + 1, _INVERSE)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return mix(raw + (ends - starts).astype(np.uint64) * _STEP)


class Block:
    """Words of the texts of a block: byte places, document of each word, word hashes."""

    def __init__(self, texts: list[bytes], fold: bytes | None = None):
        joined = b" ".join(texts) + b" "
        self.folded = joined.translate(fold) if fold else joined
        self.bytes = np.frombuffer(self.folded, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.stops = np.cumsum(sizes + 1) - 1
        self.begins = self.stops - sizes
        space = _IS_SPACE[self.bytes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.stops, self.starts)
        self.n_docs = len(texts)
        self.n_words = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.first_word = np.cumsum(self.n_words) - self.n_words
        self.hashes = Hashes(self.bytes)

    def word_hashes(self) -> np.ndarray:
        return self.hashes.of(self.starts, self.ends)

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of the runs of `width` words within a document, and their first words."""
        w = self.word_hashes()
        if len(w) < width:
            return w[:0], np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            out = w[: len(w) - width + 1]
            for k in range(1, width):
                out = pair(out, w[k : len(w) - width + 1 + k])
        first = np.flatnonzero(self.doc[: len(out)] == self.doc[width - 1 :])
        return out[first], first


def repeats(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether its value occurs again in its group, and whether it occurred before."""
    order = np.lexsort((np.arange(len(values)), values, groups))
    g, v = groups[order], values[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    again, before = np.zeros(len(values), bool), np.zeros(len(values), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    before[order[1:]] = same
    return again, before

"""Periodic runs of words, by internal pattern matching of dyadic blocks.

The words of a block of documents are one sequence in which a word means something else in every
document, so no match leaves its document.  Prefix doubling sorts its suffixes and keeps, for each
power of two, the rank of every factor of that length.  For each power b, blocks of b words at
every b / 2 words ask where they occur again: a wavelet tree over the suffix array gives the
occurrences within a range of places (range successor).  A run of period q holds such a block in
its first q words, and the same block q words later, where b is chosen by q.  Occurrences of a block
in a window of at most b starts form a progression: two or fewer are tried as periods; three or more
have the block's own period as difference, and are tried unless they lie in the same stretch
of that period as the block.  Every candidate is extended to both sides through the ranks, so what is returned
is exact.

Defined results: null, empty and wordless text has no words, no runs and an empty collapsed text;
rows keep their number, so repeated rows and shared or null ids give a row each; other columns are
left out.  A text is held by one task, with about 4 bytes a word and power of two up to its longest
repeat.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, wavelet
from .base import blocks
from .wavelet import WaveletTree

# Workers get these modules by value, so executors need no installed package.
for _module in (base, wavelet, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

#: Fewest words of a run, whatever its period.
LEAST = 12

#: Text whose words are sorted together.
BLOCK_BYTES = 1_000_000

#: The shortest blocks have 2 ** FIRST words, the longest of which LEAST words hold two at any period.
FIRST = 2

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Factors:
    """Suffix array of a sequence of word numbers, with the ranks of its factors of 2 ** k words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        order = np.argsort(words, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = words[order[1:]] != words[order[:-1]]
        self.ranks, self.heads = [], []
        rank = np.empty(n, np.int32)
        heads = np.flatnonzero(fresh)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        while True:
            self.ranks.append(rank)
            self.heads.append(heads)
            if len(heads) == n:
                break
            # Only places whose factor occurs twice are sorted on, by the factor that follows.
            sizes = np.diff(np.append(heads, n))
            open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
            at = order[open_]
            later = at + (1 << (len(self.ranks) - 1))
            follow = np.where(later < n, rank[np.minimum(later, n - 1)].astype(np.int64) + 1, 0)
            own = rank[at].astype(np.int64)
            key = own * (n + 1) + follow
            by = np.argsort(key, kind="stable")
            order[open_] = at[by]
            key = key[by]
            fresh = np.ones(n, bool)
            fresh[open_[1:]] = key[1:] != key[:-1]
            heads = np.flatnonzero(fresh)
            rank = np.empty(n, np.int32)
            rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        self.order = order

    def ends(self, k: int, head: np.ndarray) -> np.ndarray:
        """Where the interval of the suffix array that begins at `head` ends, for factors of 2 ** k."""
        heads = self.heads[k]
        after = np.searchsorted(heads, head, side="right")
        return np.where(after < len(heads), heads[np.minimum(after, len(heads) - 1)], self.n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, n = self.ranks[k], self.n
            same = (j < n) & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = 1 << k
            rank = self.ranks[k]
            same = (i >= step) & (rank[np.maximum(i - step, 0)] == rank[np.maximum(j - step, 0)])
            i[same] -= step
            j[same] -= step
        return start - i


def _windows(k: int) -> list[tuple[int, int]]:
    """Ranges of periods, none wider than the block, for which blocks of 2 ** k words are asked."""
    b = 1 << k
    low, high = (1, 3 * b - 2) if k == FIRST else (3 * b // 2 - 1, 3 * b - 2)
    middle = (low + high) // 2
    return [(low, middle), (middle + 1, high)]


def _candidates(factors: Factors, k: int, tree: WaveletTree, places: np.ndarray, kept: np.ndarray
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of blocks of 2 ** k words that occur again a period later."""
    b, n = 1 << k, factors.n
    at = np.arange(0, n - b + 1, b // 2)
    head = factors.ranks[k][at].astype(np.int64)
    tail = factors.ends(k, head)
    again = tail - head > 1
    at, left, right = at[again], kept[head[again]], kept[tail[again]]
    for low, high in _windows(k):
        first = tree.below(left, right, np.searchsorted(places, at + low))
        count = tree.below(left, right, np.searchsorted(places, at + high + 1)) - first
        for m in (1, 2):
            some = np.flatnonzero((count >= m) & (count <= 2))
            if len(some):
                found = places[tree.smallest(left[some], right[some], first[some] + m - 1)]
                yield at[some], found - at[some]
        many = np.flatnonzero(count > 2)
        if not len(many):
            continue
        i, size = at[many], count[many]
        one = places[tree.smallest(left[many], right[many], first[many])]
        two = places[tree.smallest(left[many], right[many], first[many] + 1)]
        step = two - one
        yield i, step
        apart = np.flatnonzero(i - factors.backward(i, i + step) != one - factors.backward(one, one + step))
        if len(apart):
            i, one, step, size = i[apart], one[apart], step[apart], size[apart]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(i, size), np.repeat(one - i, size) + nth * np.repeat(step, size)


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every maximal run, ordered by start and period.

    `words` are numbers; a run has at least max(least, 2 * period) words, and `least` is at least 12.
    """
    none = np.zeros((0, 3), np.int64)
    if len(words) < least:
        return none
    factors = Factors(words)
    if len(factors.heads) <= FIRST:
        return none
    # The tree holds the places whose shortest block occurs twice, in the order of the suffix array.
    head = factors.ranks[FIRST][factors.order].astype(np.int64)
    twice = factors.ends(FIRST, head) - head > 1
    kept = np.concatenate(([0], np.cumsum(twice)))
    inside = factors.order[twice].astype(np.int64)
    if not len(inside):
        return none
    places = np.sort(inside)
    tree = WaveletTree(np.searchsorted(places, inside), len(places))
    found = []
    for k in range(FIRST, len(factors.ranks)):
        if (1 << k) * 3 - 3 > len(words):
            break
        for at, period in _candidates(factors, k, tree, places, kept):
            back = factors.backward(at, at + period)
            length = back + period + factors.forward(at, at + period)
            whole = length >= np.maximum(least, 2 * period)
            found.append(np.stack((at - back, length, period), axis=1)[whole])
    rows = np.concatenate(found) if found else none
    # Of periods of the same stretch the smallest is its period; the others are its multiples.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def scan(texts: list[bytes], least: int = LEAST) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text, and its runs with starts numbered from its first word."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    runs = [np.zeros((0, 3), np.int64)] * len(texts)
    long = np.flatnonzero(sizes >= least)
    if not len(long):
        return words, runs
    codes, known = pd.factorize(np.array([w for d in long for w in words[d]], dtype=object))
    of = np.repeat(np.arange(len(long)), sizes[long])
    rows = find_runs(of * np.int64(len(known)) + codes, least)
    ends = np.cumsum(sizes[long])
    owner = np.searchsorted(ends, rows[:, 0], side="right")
    rows[:, 0] -= (ends - sizes[long])[owner]
    cuts = np.searchsorted(owner, np.arange(len(long) + 1))
    for k, d in enumerate(long):
        runs[d] = rows[cuts[k] : cuts[k + 1]]
    return words, runs


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside all repetitions of runs, joined by one space; first periods stay."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words; by start, then period), collapsed.

    A run is a stretch of words with smallest period q and at least max(least, 2 * q) words that no
    neighbouring word extends.  `collapsed` is the text without the words that a run repeats.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for piece, texts in blocks(batches, "text", block_bytes):
            words, runs = scan(texts, least)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind.value_type))
            yield pa.record_batch(
                [
                    piece.column("id"), pa.array([len(w) for w in words], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), spans).cast(kind),
                    pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(task, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of `documents` in which every tenth document, by a hash of its id, ends in a repetition.

    With n words, h the CRC-32 of the decimal id and g = floor(h / 10), word i >= a of a document with h % 10 = 0
    becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", "text", h.alias("h"),
                      F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    cut = cut.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    cut = cut.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("a")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    whole = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of runs and text."""
    key = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(key)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    some = F.size("runs") > 0
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"), (-best["l"]).alias("length"),
        best["p"].alias("period"), F.floor(-1000 * best["l"] / best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.when(some, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )

"""Character and word statistics by histograms, a slice of a batch at a time.

Counting needs no order: code points below 256 fall into dense bins of their text, the rest into a sparse
table, so the cost of a text is its length, without the sort that array functions need to group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers get these functions by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are counted together.
SLICE_BYTES = 1 << 20

#: Words that are counted together.
SLICE_WORDS = 1 << 19


def _slices(codes: pa.Array) -> Iterator[pa.Array]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(codes), 0), dtype=np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(codes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield codes.slice(a, b - a)


def entropies(codes: pa.Array) -> np.ndarray:
    """Shannon entropy in bits over the code points of each text; 0 for empty text and null."""
    texts = [t or "" for t in codes.to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    low = points < 256
    dense = np.bincount(row[low] * 256 + points[low], minlength=len(texts) * 256).astype(np.float64)
    # One addend after the other, by code point, and Spark's log2: the result of the sorted form to the last bit.
    weighted = np.zeros(len(texts))
    for column in (dense * _log2(np.maximum(dense, 1))).reshape(-1, 256).T:
        weighted += column
    if not low.all():
        keys, counts = np.unique((row[~low] << 32) | points[~low], return_counts=True)
        np.add.at(weighted, keys >> 32, counts * _log2(counts))
    n = np.maximum(sizes, 1)
    return np.where(sizes > 0, _log2(n) - weighted / n, 0.0)


def _log2(values: np.ndarray) -> np.ndarray:
    return np.log(values) / np.log(2.0)


@F.arrow_udf(T.DoubleType())
def char_entropy(codes: pa.Array) -> pa.Array:
    made = [entropies(part) for part in _slices(codes)]
    return pa.array(np.concatenate(made) if made else np.zeros(0))


WORD_COUNTS = T.StructType([
    T.StructField(name, T.LongType())
    for name in ("words", "distinct", "repeated", "names", "letters", "short", "snake", "camel")
])


def _traits(stock: pa.Array, keywords: list[str]) -> list[np.ndarray]:
    """Of each word: whether it is a name, its letters, whether it is short, in snake case, in camel case.

    A name is ASCII, longer than one character, no keyword, and does not start with a digit.
    """
    letters = np.asarray(pc.utf8_length(stock), dtype=np.int64)
    plain = np.asarray(pc.binary_length(stock)) == letters
    first = np.asarray(pc.greater_equal(stock, ":"))
    known = np.asarray(pc.is_in(stock, value_set=pa.array(keywords, pa.string())))
    snake = np.asarray(pc.and_(pc.match_substring(stock, "_"), pc.equal(stock, pc.ascii_lower(stock))))
    camel = np.asarray(pc.match_substring_regex(stock, "^[a-z]+[A-Z]"))
    return [plain & first & ~known & (letters > 1), letters, letters <= 2, snake, camel]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[start], np.diff(np.append(start, len(values)))


def _word_counts(words: pa.ListArray, keywords: list[str]) -> np.ndarray:
    """The columns of WORD_COUNTS, a row for each list of words."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0), dtype=np.int64)
    rows, coded = len(words), words.flatten().dictionary_encode()
    code, stock = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    row = np.repeat(np.arange(rows), sizes)
    out = np.zeros((rows, len(WORD_COUNTS)), np.int64)
    out[:, 0] = sizes
    if not len(code):
        return out

    v = len(stock)
    key, _ = _runs(row * v + code)
    out[:, 1] = np.bincount(key // v, minlength=rows)
    within = row[1:] == row[:-1]
    two, base = code[:-1][within] * v + code[1:][within], v * v
    if rows * base >= 1 << 62:
        # Numbers of the pairs that occur, where row and pair do not fit one integer.
        stock_of_two, two = np.unique(two, return_inverse=True)
        base = max(len(stock_of_two), 1)
    key, n = _runs(row[1:][within] * base + two)
    out[:, 2] = np.bincount(key // base, weights=np.where(n > 1, n, 0), minlength=rows)
    name, *traits = _traits(stock, keywords)
    some = name[code]
    code, row = code[some], row[some]
    out[:, 3] = np.bincount(row, minlength=rows)
    for k, values in enumerate(traits):
        out[:, 4 + k] = np.bincount(row, weights=values[code], minlength=rows)
    return out


def word_counts(keywords: list[str]):
    """An Arrow function of words, one a line and null for none: their number, distinct words, adjacent
    pairs that occur more than once, and the names among the words by their kind."""
    @F.arrow_udf(WORD_COUNTS)
    def counts(lines: pa.Array) -> pa.Array:
        words = pc.split_pattern(lines, "\n")
        sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0), dtype=np.int64)
        part = np.cumsum(sizes) // SLICE_WORDS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
        made = [_word_counts(words.slice(a, b - a), keywords) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        table = np.concatenate(made) if made else np.zeros((0, len(WORD_COUNTS)), np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in table.T], names=WORD_COUNTS.names)

    return counts

"""Spelling variants: PartEnum signatures over letter multisets, joined and verified.

A word is the set of its (letter, how often it came before) pairs, a binary vector.  One inserted,
deleted or replaced letter changes at most two of its entries.  The entries are dealt into PARTS
parts of about equal information; two vectors at Hamming distance two or less agree on all but
two parts, so on at least one choice of PARTS - 2 of them.  Each choice gives one signature, the
hash of what the word has in those parts.  An edit also leaves the first or the last END letters
as they are (words have at least twice as many), so every signature is taken once with each end;
that loses nothing and keeps signatures of common letters short.  Words with an equal signature
are joined, and a pair stays if its edit distance is exactly one.

Counts are added up within tasks before they move, and only the vocabulary is joined, never the text;
all joins are by sorting, none by a table that passes through the driver.

Defined results: null, empty and letterless text has no words; a null id counts as the empty string
in the hash of `planted`; repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, qgrams
from ..session import write_and_read
from .base import LOWER, blocks
from .qgrams import mix

# Workers get these modules by value, so executors need no installed package.
for _module in (base, qgrams, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

#: Fewest code points and occurrences of a word; how much more frequent the form of a variant is.
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5

PARTS, DISTANCE = 5, 2

#: Letters at either end of which one end is left as it is by an edit.
END = LEAST_LETTERS // 2

#: Distinct words that a task counts before it sends them on.
HELD = 200_000

#: Occurrences of a letter in a word that are told apart when entries are dealt into parts.
NTH = 8

_LETTERS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")

Change = Callable[[int | None, str], str]


def planted(doc_id: int | None, word: str) -> str:
    """The word without one code point, where 199 divides the CRC-32 of `<doc_id>:<word>`."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 199:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Change | None = None) -> DataFrame:
    """word, n of the runs of letters, lower-cased in A-Z, that have LEAST_LETTERS code points or more.

    `change` may replace the words of a document, and may only shorten them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for piece, texts in blocks(batches):
            for doc_id, text in zip(piece.column("id").to_pylist(), texts):
                for word, n in Counter(_LETTERS.findall(text.translate(LOWER).decode("utf-8", "replace"))).items():
                    if change is not None:
                        word = change(doc_id, word)
                        if len(word) < LEAST_LETTERS:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def entries(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, letter, nth) of every letter of the words, ordered by row; nth counts equal letters from 0."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    key = row << 32 | letters
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(first)
    nth = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return row[order], letters[order], nth


def deal(counts: list[tuple[int, int, int]], words: int) -> np.ndarray:
    """The part of every (letter, nth): entries by falling information, each to the part that has least."""
    part = (np.arange(256)[:, None] + np.arange(NTH)[None, :]) % PARTS
    load = [0.0] * PARTS
    weighed = []
    for letter, nth, n in counts:
        p = min(max(n / max(words, 1), 1e-9), 1 - 1e-9)
        weighed.append((-(p * np.log2(p) + (1 - p) * np.log2(1 - p)), letter, nth))
    for bits, letter, nth in sorted(weighed, reverse=True):
        least = min(range(PARTS), key=load.__getitem__)
        part[letter, nth] = least
        load[least] += bits
    return part


def signatures(words: list[str], part: np.ndarray) -> np.ndarray:
    """Signatures of the words, one row each: every choice of parts with either end."""
    row, letter, nth = entries(words)
    cuts = np.searchsorted(row, np.arange(len(words) + 1))
    with np.errstate(over="ignore"):
        value = mix((letter << 32 | nth).astype(np.uint64) + np.uint64(1))
        of = part[letter & 255, np.minimum(nth, NTH - 1)]
        sums = np.empty((len(words), PARTS), np.uint64)
        for p in range(PARTS):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(of == p, value, 0), dtype=np.uint64)))
            sums[:, p] = total[cuts[1:]] - total[cuts[:-1]]
        ends = [np.array([zlib.crc32(e(w).encode()) << 1 | k for w in words], np.uint64)
                for k, e in enumerate((lambda w: w[:END], lambda w: w[-END:]))]
        out = []
        for k, chosen in enumerate(itertools.combinations(range(PARTS), PARTS - DISTANCE)):
            have = mix(sums[:, list(chosen)].sum(axis=1, dtype=np.uint64) + np.uint64(k << 56))
            out += [mix(have ^ mix(e)) for e in ends]
    return np.stack(out, axis=1).view(np.int64)


def _parts(vocabulary: DataFrame) -> np.ndarray:
    """Deals entries by how many words have them: one row for a letter and occurrence, at most 256 x NTH."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((256, NTH), np.int64)
        words = 0
        for batch in batches:
            texts = batch.column("word").to_pylist()
            _, letter, nth = entries(texts)
            told = nth < NTH
            total += np.bincount((letter[told] & 255) * NTH + nth[told], minlength=256 * NTH).reshape(256, NTH)
            words += len(texts)
        letter, nth = np.nonzero(total)
        yield pa.record_batch(
            [pa.array(np.append(letter, -1)), pa.array(np.append(nth, 0)), pa.array(np.append(total[letter, nth], words))],
            names=["letter", "nth", "n"])

    rows = vocabulary.select("word").mapInArrow(task, "letter long, nth long, n long").groupBy("letter", "nth").agg(F.sum("n").alias("n")).collect()
    words = sum(r.n for r in rows if r.letter < 0)
    return deal([(r.letter, r.nth, r.n) for r in rows if r.letter >= 0], words)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of every two words (a before b) at edit distance one; `vocabulary` has word, n, each word once."""
    part = _parts(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                piece = batch.slice(k, 2000)
                sig = signatures(piece.column("word").to_pylist(), part)
                rows = pa.array(np.repeat(np.arange(piece.num_rows), sig.shape[1]))
                yield pa.record_batch([pa.array(sig.ravel()), piece.column("word").take(rows), piece.column("n").take(rows)],
                                      names=["signature", "word", "n"])

    signed = vocabulary.select("word", "n").mapInArrow(task, "signature long, word string, n long")
    a = signed.select("signature", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = signed.select(F.col("signature").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    close = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    # Spark sizes the signatures of a word like the word alone, so without the hint it would send them all to the driver.
    return a.hint("merge").join(b.hint("merge"), (F.col("signature") == F.col("other")) & (F.col("a") < F.col("b")) & close).select("a", "b", "n_a", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of forms (word, form): the last word that following forms reaches.

    Forms are RATIO times as frequent as their word, so chains end, and pointers double until none moves.
    """
    at = write_and_read(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = write_and_read(
            at.join(step.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots")
        if not at.filter("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Change | None = None,
             least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with `least_count` occurrences or more.

    form is the near word of largest n (ties: smallest by code points) if that n is `ratio` times the
    word's or more, root the end of the chain of forms (the word itself without one).
    """
    vocabulary = write_and_read(word_counts(docs, id_col, text_col, change).filter(F.col("n") >= least_count), "spelling-words")
    pairs = near_words(vocabulary)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
    )).alias("s")).select("s.*")
    best = sides.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("o"))).alias("best"))
    taken = -F.col("best.k") >= ratio * F.col("n")
    near = write_and_read(
        best.select("word", "n_near", F.when(taken, F.col("best.o")).alias("form"), F.when(taken, -F.col("best.k")).alias("form_n")), "spelling-near")
    ends = roots(near.filter("form is not null").select("word", "form"))
    return vocabulary.join(near.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")

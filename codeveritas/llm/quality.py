"""Quality rules: base rules on whole texts, then gradient-boosted trees over document statistics.

Statistics come from numpy over a block of texts at a time.  Trees are grown here: squared second-order
gain on the logistic loss over quantile bins, depth-first to a fixed depth, with monotonic
constraints (a split on a constrained feature is refused if its two leaf values are in the wrong
order, and the children keep the middle of the two values as a bound).  All trees are flattened into
node arrays; scoring moves the rows of a block down all levels with array look-ups.

Training reads a bounded sample of labelled rows: the `per_class` documents of each class with the
smallest hashes of their ids, each as one row of statistics, weighted to the shares of the classes.

Defined results: null, empty and wordless text has zero statistics and fails the base rules; lines
are split at line feeds and compared byte by byte; repeated rows and null ids keep a row each; labels
that are null or for absent documents are not used; with no labels, or one class, every text that
passes the base rules is kept (dropped, if the one class is 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import blocks
from .text_stats import SYMBOLS, Block, repeats

#: Base rules (fixed values).
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5

#: Labelled documents of each class that training reads.
PER_CLASS = 20_000
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 64
LEAST_WEIGHT = 5.0
RIDGE = 1.0

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features of the trees, and the direction in which a higher value may move the verdict.
FEATURES = (
    ("words", 0), ("chars_per_word", 0), ("symbol_share", -1), ("dup_line_share", -1),
    ("repeat_share", -1), ("upper_share", 0), ("digit_share", 0), ("punctuation_share", 0),
    ("words_per_line", 0), ("distinct_share", 1), ("pipe_share", 0), ("non_ascii_share", 0),
    ("words_per_stop", 0), ("longest_word", 0),
)


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base statistics (int64, len x 5) and features (float64, len x 14) of a block of texts."""
    block = Block(texts)
    n = block.n_docs
    buffer = block.bytes
    size = np.maximum(block.stops - block.begins, 1).astype(np.float64)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[block.stops] - sums[block.begins]

    head = (buffer & 0xC0) != 0x80
    sums = np.concatenate(([0], np.cumsum(head, dtype=np.int64)))
    points = sums[block.ends] - sums[block.starts]
    word_chars = np.bincount(block.doc, weights=points, minlength=n).astype(np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, block.doc, points)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = per_doc(symbol[buffer])

    # Lines: cut at line feeds and at the blank behind each text.
    cut = buffer == 10
    cut[block.stops] = True
    line_end = np.flatnonzero(cut)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    line_doc = np.searchsorted(block.stops, line_start)
    word_line = np.bincount(np.searchsorted(line_end, block.starts), minlength=len(line_end)) > 0
    a, b, d = line_start[word_line], line_end[word_line], line_doc[word_line]
    _, before = repeats(d, block.hashes.of(a, b))
    n_dup_lines = np.bincount(d, weights=before, minlength=n).astype(np.int64)
    n_lines = np.maximum(np.bincount(d, minlength=n), 1)

    ids, first = block.shingles(WINDOW)
    again, _ = repeats(block.doc[first], ids)
    cover = np.zeros(len(block.starts) + WINDOW + 1, np.int64)
    at = first[again]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    inside = np.cumsum(cover)[: len(block.starts)] > 0
    n_repeat = np.bincount(block.doc, weights=inside, minlength=n).astype(np.int64)

    words = np.maximum(block.n_words, 1).astype(np.float64)
    _, seen = repeats(block.doc, block.word_hashes())
    distinct = np.bincount(block.doc, weights=~seen, minlength=n)
    upper = per_doc((buffer >= 65) & (buffer <= 90))
    digits = per_doc((buffer >= 48) & (buffer <= 57))
    stops = per_doc((buffer == 46) | (buffer == 33) | (buffer == 63))
    marks = per_doc((buffer == 44) | (buffer == 46) | (buffer == 33) | (buffer == 63) | (buffer == 58) | (buffer == 59))
    base = np.column_stack((block.n_words, word_chars, n_symbols, n_dup_lines, n_repeat))
    features = np.column_stack((
        block.n_words, word_chars / words, n_symbols / size, n_dup_lines / n_lines, n_repeat / words,
        upper / size, digits / size, marks / size, words / n_lines, distinct / words,
        per_doc(buffer == 124) / words, per_doc(buffer >= 128) / size, words / (stops + 1.0), longest,
    ))
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED_PERCENT * base[:, 0])


@dataclass
class Forest:
    """Flattened trees: node k splits `feature[k]` at `cut[k]`; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        index = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            low = rows[index, self.feature[at]] <= self.cut[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)


def grow(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, directions: np.ndarray,
         trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees on the logistic loss."""
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    codes = np.column_stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)])
    share = float(np.clip((weights * labels).sum() / weights.sum(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(rows), start)
    nodes: list[list[float]] = []
    roots = []

    def leaf(value: float) -> int:
        k = len(nodes)
        nodes.append([0, 0.0, k, k, value])
        return k

    def split(member: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[member].sum(), h[member].sum()
        value = float(np.clip(-total_g / (total_h + RIDGE), low, high))
        best = None
        if level < depth:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(codes[member, f], weights=g[member], minlength=len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(codes[member, f], weights=h[member], minlength=len(c) + 1))[:-1]
                rest_g, rest_h = total_g - gs, total_h - hs
                vl = np.clip(-gs / (hs + RIDGE), low, high)
                vr = np.clip(-rest_g / (rest_h + RIDGE), low, high)
                # Loss of a leaf with value v, to the second order: g v + (h + ridge) v^2 / 2.
                loss = (gs * vl + (hs + RIDGE) * vl**2 / 2) + (rest_g * vr + (rest_h + RIDGE) * vr**2 / 2)
                whole = total_g * value + (total_h + RIDGE) * value**2 / 2
                gain = np.where((hs >= LEAST_WEIGHT * 0.05) & (rest_h >= LEAST_WEIGHT * 0.05), whole - loss, -np.inf)
                if directions[f]:
                    gain = np.where(directions[f] * (vr - vl) >= 0, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        if best is None:
            margin[member] += rate * value
            return leaf(rate * value)
        _, f, k, vl, vr = best
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}[int(directions[f])]
        place = len(nodes)
        nodes.append([f, cuts[f][k], 0, 0, 0.0])
        goes = codes[member, f] <= k
        nodes[place][2] = split(member[goes], g, h, level + 1, *bounds[0])
        nodes[place][3] = split(member[~goes], g, h, level + 1, *bounds[1])
        return place

    everyone = np.arange(len(rows))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weights * (p - labels), weights * p * (1 - p)
        roots.append(split(everyone, g, h, 0, -8.0, 8.0))
    table = np.array(nodes)
    return Forest(
        table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64),
        table[:, 3].astype(np.int64), table[:, 4], np.array(roots), depth, start,
    )


def _constant(share: float) -> Forest:
    zero = np.zeros(1, np.int64)
    return Forest(zero, np.zeros(1), zero, zero, np.zeros(1), zero, 0, 60.0 * (share - 0.5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = PER_CLASS) -> Forest:
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("mark"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("mark").isin(0, 1))
    totals = dict(marks.groupBy("mark").count().collect())
    if len(totals) < 2:
        return _constant(1.0 if not totals else float(next(iter(totals))))
    chosen = None
    for mark in (0, 1):
        part = marks.filter(F.col("mark") == mark).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class narrow rows, so their side is small enough to broadcast.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("id", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(list(statistics(found)[1]), pa.list_(pa.float64()))],
                names=["id", "mark", "features"],
            )

    got = sample.mapInArrow(run, "id long, mark int, features array<double>").toArrow().sort_by("id")
    mark = got["mark"].to_numpy().astype(np.int64)
    rows = np.array(got["features"].to_pylist(), np.float64).reshape(len(mark), len(FEATURES))
    weight = np.array([totals[k] / sum(totals.values()) * len(mark) / max(1, (mark == k).sum()) for k in (0, 1)])
    return grow(rows, mark.astype(np.float64), weight[mark], np.array([d for _, d in FEATURES]))


def judge(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """`docs` with the base statistics, base_failed, quality (0 to 1) and kept; one narrow map.

    Columns of these names that `docs` brings are replaced.
    """
    new = [*BASE, "base_failed", "quality", "kept"]
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(
        *[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        *[F.lit(0).cast("long").alias(c) for c in BASE],
        F.lit(False).alias("base_failed"), F.lit(0.0).alias("quality"), F.lit(False).alias("kept"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col):
            base, features = statistics(texts)
            failed = base_failed(base)
            margin = forest.margin(features)
            columns = [batch.column(i) for i in range(batch.num_columns - len(new))]
            columns += [pa.array(base[:, k]) for k in range(len(BASE))]
            columns += [pa.array(failed), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30)))), pa.array(~failed & (margin >= 0))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)

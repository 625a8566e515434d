"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character n-grams (3 to 5, word ends marked) of its distinct lower-case
words, and each word as a whole; each n-gram has an embedding, found by hashing into `2 ** BUCKET_BITS` rows.
The average embedding goes through a linear softmax over two classes; embeddings and softmax are
trained jointly in numpy by Adagrad on the cross-entropy.  A misspelling that was never seen shares
most of its n-grams, so most of its vector, with the word it comes from.

As averaging and softmax input are linear, every n-gram adds a fixed amount to the difference of the
two class scores.  Scoring sums these amounts, per distinct word once and then per text.

Training reads a bounded sample of the labelled rows, `per_class[k]` documents of class k with the
smallest hashes of their ids, as n-gram counts (at most `2 ** BUCKET_BITS` pairs a document).  The
driver holds them packed, but for those of the mini-batch at hand.
Classes are weighted so that the sample stands for their shares in all labelled rows.

Defined results: null, empty and wordless texts get the score of an empty bag, which is the bias;
labels that are null or for absent documents are not used; a document with several labels counts
once for each; without any labelled row, or with one class only, the score is that class's share
(0.5 without rows); repeated rows and null ids keep a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import blocks
from .qgrams import mix

BUCKET_BITS = 17
WIDTH = 16
LENGTHS = (3, 4, 5)

#: Labelled documents of class 0 and of class 1 that training reads.
PER_CLASS = (5_000, 1_500)
EPOCHS = 10

#: Updates that a small sample gets at least, in more epochs.
LEAST_STEPS = 600
BATCH = 64
RATE = 0.5

#: N-grams without effect that are averaged in, so that a few words decide less than many.
EMPTY = 150.0

#: Distinct words a task remembers.
REMEMBERED = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, and the place of the word each belongs to."""
    line = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(points))
    buckets, owners = [], []
    spread = mix(points + _STEP)
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if n > len(points):
            break
        rolled = rolled[: len(points) - n + 1] * _STEP + spread[n - 1 :]
        if n in LENGTHS:
            whole = left[: len(rolled)] >= n
            buckets.append(mix(rolled[whole] + np.uint64(n)))
            owners.append(owner[: len(rolled)][whole])
    starts = ends - lengths
    sums = np.concatenate(([np.uint64(0)], np.cumsum(spread * (np.arange(len(points)) - starts[owner] + 7).astype(np.uint64) ** np.uint64(3))))
    buckets.append(mix(sums[ends] - sums[starts] + np.uint64(1)))
    owners.append(np.arange(len(words)))
    joined = np.concatenate(buckets) >> np.uint64(64 - BUCKET_BITS)
    return joined.astype(np.int32), np.concatenate(owners)


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, _ = ngram_buckets(list(dict.fromkeys(words)))
    counts = np.bincount(buckets, minlength=1)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found].astype(np.float32)


def pack(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag as the steps between its buckets and its counts, each in the least width; two bytes tell the widths."""
    parts = [x.astype(f"<u{np.min_scalar_type(int(x.max(initial=0))).itemsize}") for x in (np.diff(buckets, prepend=0), counts)]
    return bytes(x.itemsize for x in parts) + b"".join(x.tobytes() for x in parts)


class Packed(Sequence):
    """Bags that are unpacked when asked for."""

    def __init__(self, bags: list[bytes]):
        self.bags = bags

    def __len__(self) -> int:
        return len(self.bags)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        line = self.bags[k]
        wide, of_count = line[:2]
        n = (len(line) - 2) // (wide + of_count)
        steps = np.frombuffer(line, f"<u{wide}", n, 2)
        return np.cumsum(steps, dtype=np.int32), np.frombuffer(line, f"<u{of_count}", n, 2 + n * wide).astype(np.float32)


@dataclass
class Model:
    """What each n-gram adds to the difference of the class scores, and the bias."""

    amounts: np.ndarray
    bias: float

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def train(bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray,
          epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> Model:
    """Embeddings, softmax weights and bias by mini-batch Adagrad."""
    n_buckets = 1 << BUCKET_BITS
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (n_buckets, WIDTH)).astype(np.float32)
    soft = draw.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    past = [np.full_like(x, 1e-6) for x in (embed, soft, bias)]
    want = np.eye(2, dtype=np.float32)[labels]
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(bags))))):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            chosen = [bags[r] for r in rows]
            ids = np.concatenate([b for b, _ in chosen])
            used, column = np.unique(ids, return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            line = np.repeat(np.arange(len(rows)), [len(b) for b, _ in chosen])
            x[line, column] = np.concatenate([c / (c.sum() + EMPTY) for _, c in chosen])
            hidden = x @ embed[used]
            z = hidden @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - want[rows]) * weights[rows, None] / len(rows)
            for value, grad, seen, at_rows in (
                (embed, (x.T @ g) @ soft.T, past[0], used),
                (soft, hidden.T @ g, past[1], slice(None)),
                (bias, g.sum(axis=0), past[2], slice(None)),
            ):
                seen[at_rows] += grad * grad
                value[at_rows] -= rate * grad / np.sqrt(seen[at_rows])
    turn = soft[:, 1] - soft[:, 0]
    return Model((embed @ turn).astype(np.float64), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; remembers what the n-grams of a word add up to."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        buckets, owners = ngram_buckets(words)
        sums = np.bincount(owners, weights=self.model.amounts[buckets], minlength=len(words))
        counts = np.bincount(owners, minlength=len(words))
        self.known.update(zip(words, zip(sums.tolist(), counts.tolist())))

    def scores(self, texts: list[str]) -> np.ndarray:
        lists = [set(split_words(t)) for t in texts]
        known = self.known
        if new := list({w for ws in lists for w in ws if w not in known}):
            self.learn(new)
            known = self.known
            if gone := list({w for ws in lists for w in ws if w not in known}):
                self.learn(gone)
        means = np.zeros(len(texts))
        for i, ws in enumerate(lists):
            total = count = 0.0
            for pair in map(known.__getitem__, sorted(ws)):
                total += pair[0]
                count += pair[1]
            means[i] = total / (count + EMPTY)
        return self.model.probability(means)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Model:
    """Trains on labelled rows outside the held-out fold."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("mark"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("mark").isin(0, 1) & ~held_out(F.col("id")))
    totals = dict(marks.groupBy("mark").count().collect())
    if len(totals) < 2:
        share = 0.5 if not totals else float(next(iter(totals)))
        return Model(np.zeros(1 << BUCKET_BITS), 60.0 * (share - 0.5))
    chosen = None
    for mark in (0, 1):
        part = marks.filter(F.col("mark") == mark).orderBy(F.xxhash64("id"), "id").limit(per_class[mark])
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most sum(per_class) narrow rows, so their side is small enough to broadcast.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("id", "mark", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in blocks(batches):
            packed = pa.array([pack(*bag(t.decode())) for t in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), packed], names=["id", "mark", "bag"])

    got = sample.mapInArrow(bags, "id long, mark int, bag binary").toArrow()
    marked = got["mark"].to_numpy().astype(np.int64)
    order = np.lexsort((marked, got["id"].to_numpy()))
    rows, marked = got["bag"].to_pylist(), marked[order]
    del got
    sampled = np.bincount(marked, minlength=2)
    weight = np.array([totals[k] / sum(totals.values()) * len(rows) / max(1, sampled[k]) for k in (0, 1)])
    return train(Packed([rows[k] for k in order]), marked, weight[marked].astype(np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1; one narrow map.  An own column of that name is replaced."""
    kept = [c for c in docs.columns if c != score_col]
    rows = docs.select(
        *[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        F.lit(0.0).alias(score_col),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch, texts in blocks(batches, text_col):
            got = pa.array(scorer.scores([t.decode() for t in texts]))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, got], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)

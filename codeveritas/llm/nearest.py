"""Nearest neighbours by largest inner product: multi-index hashing of learned rotated binary codes.

Vectors get one more component that brings all of them to the norm of the longest, so the angle to a
query orders them as the inner product does.  BITS sign bits of the vector under rotations, each fitted
to a sample so that signs lose least (iterative quantisation), are its code.  Rows are dealt
into shards by a hash of their id, so equal and close vectors are spread over all of them.  A shard cuts the
codes into m strings, each with a table from its values to bitmaps of its rows.  A query probes
the tables in two steps: for codes that share a string, the closest of which give a
bound on the inner product of its k-th neighbour; then, by pigeonhole, for every code within the Hamming radius in
which nearly all vectors of that inner product lie: of m strings of two
codes at distance m * t + a or less, one of the first a + 1 differs in t bits at most or one of the others in t - 1.
The rows around a value come from the bitmaps of the values a bit away, once for all queries of a batch.
All codes in the radius are ranked by the inner product of the original vectors in double precision.
Vectors equal in every component are one entry of the tables with the list of their ids.

The rotations are fitted on up to SAMPLE rows; every row is indexed and every query visits every shard.

Defined results: vectors that are null, empty or zero, or hold a null or a component that is not finite, and
rows without an id, take no part; of rows that share an id the least vector counts; shorter vectors
count as filled up with zeros; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Workers get this module by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Length of a code and of its strings; rows that the rotations are fitted on, and rounds of fitting.
BITS, STRING, SAMPLE, ROUNDS = 256, 8, 8192, 15

#: Rows of a shard, which one task holds; and the rows worth a task of their own.
SHARD_ROWS, TASK_ROWS = 1 << 16, 8192

#: Standard deviations above the expected Hamming distance of the k-th neighbour.
MARGIN = 1.0

#: First rows that a query ranks, as a multiple of those asked for.
FIRST = 4

#: Distinct rows of a shard that are all ranked: the codes spare no work, and may miss some.
FEW = 1024

#: Bytes of the bitmaps of queries, and vectors that are multiplied, at a time.
MARKED, MULTIPLIED = 1 << 23, 1 << 15

OUT = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec of the rows that take part, one for each id."""
    vec = F.col(f"`{vec_col}`")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & fine)
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    return rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows, filled up with zeros."""
    values = np.asarray(column.flatten())
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Codes:
    """Rotations and the norm of the longest vector; gives the sign bits of rows and of queries."""

    def __init__(self, sample: np.ndarray, width: int, longest: float, bits: int = BITS, seed: int = 1):
        self.width, self.longest, self.bits = width, longest, bits
        draw = np.random.default_rng(seed)
        x = self._lifted(sample.astype(np.float64))
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(size > 0, size, 1)
        planes = []
        while sum(p.shape[1] for p in planes) < bits:
            k = min(width + 1, bits)
            base = np.linalg.qr(draw.standard_normal((width + 1, k)))[0]
            part, turn = x @ base, np.eye(k)
            for _ in range(ROUNDS if len(x) else 0):
                u, _, v = np.linalg.svd(np.where(part @ turn >= 0, 1.0, -1.0).T @ part)
                turn = (u @ v).T
            planes.append(base @ turn)
        self.planes = np.concatenate(planes, axis=1)[:, :bits]

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x * x).sum(axis=1), 0)
        return np.concatenate((x, np.sqrt(rest)[:, None]), axis=1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._lifted(x.astype(np.float64)) @ self.planes >= 0

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return q.astype(np.float64) @ self.planes[:-1] >= 0

    def radius(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Hamming distance that a vector of this inner product rarely exceeds."""
        p = np.arccos(np.clip(score / (norm * self.longest), -1, 1)) / np.pi
        return np.ceil(self.bits * p + MARGIN * np.sqrt(self.bits * p * (1 - p))).astype(np.int64)


def _coded(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as strings of STRING bits, one byte each, and as words of 64 bits."""
    strings = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1)
    return strings, strings.view(np.uint64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Shard:
    """The tables of some rows: for each string of the code, a bitmap of the rows for each of its values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        by = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[by], vectors[by]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        self.ids, self.first = ids, np.append(np.flatnonzero(fresh), len(ids))
        self.vectors, self.codes, self.n = vectors[fresh], codes, int(fresh.sum())
        self.copies = np.diff(self.first)
        self.strings, self.words = _coded(codes.of_rows(self.vectors))
        self.m = self.strings.shape[1]
        values = np.arange(1 << STRING, dtype=np.uint8)[:, None]
        self.tables = [np.packbits(values == self.strings[None, :, j], axis=1) for j in range(self.m)]

    def _probe(self, strings: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bitmaps, one a query, of the rows whose string j differs in at most most[query, j] bits (-1: none) for some j."""
        mark = np.zeros((len(strings), self.tables[0].shape[1]), np.uint8)
        for j, ball in enumerate(self.tables):
            # Balls of one bit more are unions of the balls around the values one bit away.
            for t in range(min(int(most[:, j].max(initial=-1)), STRING) + 1):
                if t:
                    wider = ball.copy()
                    for bit in range(STRING):
                        wider |= ball[np.arange(1 << STRING) ^ (1 << bit)]
                    ball = wider
                asks = np.flatnonzero(most[:, j] == t)
                mark[asks] |= ball[strings[asks, j]]
        return mark

    def _distances(self, mark: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The marked rows and the Hamming distance of their codes."""
        row = np.flatnonzero(np.unpackbits(mark, count=self.n))
        return row, np.bitwise_count(self.words[row] ^ word).sum(axis=1, dtype=np.int64)

    def _scores(self, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Inner products in double precision, summed alike for every row."""
        cuts = range(0, max(len(row), 1), MULTIPLIED)
        return np.concatenate([(self.vectors[row[c : c + MULTIPLIED]].astype(np.float64) * q).sum(axis=1) for c in cuts])

    def _best(self, row: np.ndarray, score: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Of some rows the best that hold `need` ids together, and their scores."""
        by = np.lexsort((self.ids[self.first[row]], -score))
        held = np.cumsum(self.copies[row[by]])
        by = by[: np.searchsorted(held, need) + 1]
        return row[by], score[by]

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): for each query its k best ids here, as far as the codes show them."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, MARKED * 8 // max(self.n, 1))
        for a in range(0, len(q), step):
            part = q[a : a + step].astype(np.float64)
            for i, row in enumerate(self._near(part, k)):
                row, score = self._best(row, self._scores(part[i], row), k)
                sizes = np.minimum(self.copies[row], k)
                out.append((np.full(sizes.sum(), a + i), self.ids[_ranges(self.first[row], sizes)], np.repeat(score, sizes)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _near(self, part: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query the rows to rank: all of a few, else those within its radius."""
        if self.n <= FEW:
            yield from [np.arange(self.n)] * len(part)
            return
        strings, words = _coded(self.codes.of_queries(part))
        bound = self._bounds(part, strings, words, min(k, len(self.ids)))
        reach = self.codes.radius(bound, np.linalg.norm(part, axis=1))
        # Pigeonhole: within m * t + a bits, one of the first a + 1 strings is within t, or a later one within t - 1.
        over = np.arange(self.m)[None, :] > (reach % self.m)[:, None]
        marks = self._probe(strings, (reach // self.m)[:, None] - over)
        for i, mark in enumerate(marks):
            row, apart = self._distances(mark, words[i])
            yield row[apart <= reach[i]]

    def _bounds(self, q: np.ndarray, strings: np.ndarray, words: np.ndarray, need: int) -> np.ndarray:
        """For each query a score that `need` ids reach: that of the codes closest to its own among
        those that share a string, or are the fewest bits more apart that give enough."""
        bound = np.full(len(q), -np.inf)
        todo = np.arange(len(q))
        for most in range(STRING + 1):
            left = []
            for i, mark in zip(todo, self._probe(strings[todo], np.full((len(todo), self.m), most))):
                row, apart = self._distances(mark, words[i])
                if self.copies[row].sum() < need:
                    left.append(i)
                    continue
                if len(row) > FIRST * need:
                    row = row[np.argpartition(apart, FIRST * need)[: FIRST * need]]
                bound[i] = self._best(row, self._scores(q[i], row), need)[1][-1]
            todo = np.array(left, np.int64)
            if not len(todo):
                break
        return bound


def fit(index: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[Codes | None, int]:
    """Codes fitted on at most `sample` rows of index (id, vec), chosen by a hash of their id, and the number of rows."""
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    n, width, longest = index.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.sqrt(F.max(square))).first()
    if not n:
        return None, 0
    share = min(1.0, sample / n)
    some = index.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * sample).toArrow()
    return Codes(_matrix(some.column("vec").combine_chunks(), width), width, longest, bits), n


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: of every row of `queries` the k rows of `index` of largest inner product.

    A query's own id is no candidate; ties go to the smaller id; fewer candidates are all returned.
    """
    spark = index.sparkSession
    rows, asked = usable(index, id_col, vec_col), usable(queries, id_col, vec_col)
    codes, n = fit(rows, sample, bits)
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cores = spark.sparkContext.defaultParallelism
    shards = max(-(-n // SHARD_ROWS), min(2 * cores, -(-n // TASK_ROWS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, shard = [], [], None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            here = np.asarray(batch.column("id"))
            x = _matrix(batch.column("vec"), codes.width)
            if not asks.all():
                ids.append(here[~asks])
                vectors.append(x[~asks])
            if asks.any() and ids:
                if shard is None:
                    shard = Shard(np.concatenate(ids), np.concatenate(vectors), codes)
                    vectors.clear()
                query, found, score = shard.search(x[asks], k + 1)
                query = here[asks][query]
                other = query != found
                yield pa.record_batch([pa.array(query[other]), pa.array(found[other]), pa.array(score[other])], names=["query_id", "vec_id", "score"])

    at = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    # Rows come before the queries of their shard, so a task builds its tables once and streams the queries.
    both = rows.select(at.alias("shard"), F.lit(False).alias("asks"), "id", "vec").unionByName(
        asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "vec"))
    found = both.repartitionById(shards, "shard").sortWithinPartitions("asks", "id").select("asks", "id", "vec").mapInArrow(task, OUT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

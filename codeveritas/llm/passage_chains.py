"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Seeds are winnowed runs of K words: of each SPREAD successive runs the one with the least
identifier, so a passage that two documents share word by word over K + SPREAD - 1 words gives them
a seed in common.  All places of a seed count.  Partners of a document are found without all pairs
of a hot seed: each occurrence of a seed is linked with the seed's first place, and each seed with the
last one within REACH words with the first place of that pair, so that where the first holders of
single seeds have a part of a passage only, one that has both ends is a partner too.  A pair of seeds
that have one first holder, near each other, needs no look-up: its first place is there.

Links of a pair of documents are chained; around each chain of at least two seeds all runs of K words that both
texts have, winnowed or not and whoever their first holder is, are matched anew within a band of
diagonals.  Matches on one diagonal are joined to segments; segments are chained in order of both
documents with linear gap costs, the best predecessor within MOST_GAP words coming from a tree of
range maxima over the other document's offsets.  Chains are aligned: gaps by edit distance, the ends
by extension until the score drops; a chain with too few words in common is split at its widest gap.
Passages of at least LEAST_WORDS words in both documents and IDENTITY shared words are reported;
both are tested after alignment only.

Defined results: null, empty and short texts have no passages; a passage that occurs again in one
document is reported with an earlier place of that document if no other has it before; the two
places do not overlap; rows that share an id, null ids and repeated rows follow `base.identified`;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .base import BLOCK_BYTES, LOWER, NULL_ID, blocks, identified
from .jaccard_join import _mostly_of, node_of
from .qgrams import pair, sliding
from .text_stats import Block

K = 4
SPREAD = 4
LEAST_WORDS = 50
IDENTITY = 0.8

#: Words between the two seeds of a pair: a passage of LEAST_WORDS has both.
REACH = LEAST_WORDS - K

#: Words that the diagonals of a pair's matches may be off those of its links.
BAND = 60

#: Cost of a word of gap in a chain, and the longest gap that may be bridged.
GAP_COST = 0.1
MOST_GAP = 60

#: An extension stops where its score is so far below its best.
DROP = 6

#: Bytes of an Arrow batch of pairs.
BATCH_BYTES = 16 << 20

_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def seeds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed seeds: identifier, text, word offset; all places of each."""
    block = Block(texts, LOWER)
    ids, first = block.shingles(K)
    line = np.full(max(len(block.starts), SPREAD), _MOST, np.uint64)
    line[first] = ids
    least = sliding(line, SPREAD)
    # Windows of K-word runs that leave a text do not choose.
    doc = np.concatenate((block.doc, np.full(len(line) - len(block.doc), -1)))
    span = K + SPREAD - 1
    whole = np.zeros(len(least), bool)
    if len(doc) >= span:
        n = len(doc) - span + 1
        whole[:n] = doc[:n] == doc[span - 1 :]
    least = np.where(whole, least, np.uint64(0))
    edge = np.zeros(SPREAD - 1, np.uint64)
    best = sliding(np.concatenate((edge, least, edge)), SPREAD, np.maximum)[: len(line)]
    at = np.flatnonzero((best == line) & (line != _MOST))
    ids, text = line[at], doc[at]
    return ids, text, at - block.first_word[text]


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches):
        ids, text, at = seeds(texts)
        node = batch.column("node").to_numpy()[text]
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(node), pa.array(at.astype(np.int32))], names=["seed", "node", "at"])


def _of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Document, and place, identifier, first holder and first place of its seeds that occur elsewhere."""
    for batch in batches:
        for node, own in zip(batch.column("node").to_pylist(), batch.column("held")):
            at, seed, b, bt = (own.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "seed", "b", "bt"))
            order = np.argsort(at, kind="stable")
            yield node, at[order], seed[order], b[order], bt[order]


def _seed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each seed of a document with the last one within reach, unless their first places are so too."""
    out: list[tuple[np.ndarray, ...]] = []

    def table() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types)], names=["key", "node", "at", "to"])

    for node, at, seed, b, bt in _of_documents(batches):
        i, j = np.arange(len(at)), np.searchsorted(at, at + REACH, "right") - 1
        apart = bt[j].astype(np.int64) - bt
        some = (j > i) & ((b[j] != b) | (apart <= 0) | (apart > REACH))
        i, j = i[some], j[some]
        with np.errstate(over="ignore"):
            key = pair(seed[i].view(np.uint64), seed[j].view(np.uint64)).view(np.int64)
        out.append((key, np.full(len(i), node, np.int64), at[i], at[j]))
        if len(out) == 500:
            yield table()
            out = []
    yield table()


def _seed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a document's seeds with first places in documents that hold two of them first."""
    out: list[tuple[np.ndarray, ...]] = []

    def table() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types)], names=["a", "b", "at", "bt"])

    for node, at, _, b, bt in _of_documents(batches):
        some = (b != node) | (at - bt >= K)
        at, b, bt = at[some], b[some], bt[some]
        _, group, n = np.unique(b, return_inverse=True, return_counts=True)
        some = n[group] > 1
        out.append((np.full(some.sum(), node, np.int64), b[some], at[some], bt[some]))
        if len(out) == 500:
            yield table()
            out = []
    yield table()


def segments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matches of K words at (x, y) joined along diagonals: rows (x, y, words), sorted by x, y."""
    if len(x) <= 16:
        few, last = [], None
        for d, at in sorted(zip((x - y).tolist(), x.tolist())):
            if last is not None and d == last[0] and at - last[1] <= K + SPREAD:
                few[-1][2] = at - few[-1][0] + K
            else:
                few.append([at, at - d, K])
            last = d, at
        return np.array(sorted(few), np.int64).reshape(-1, 3)
    diagonal = x - y
    order = np.lexsort((x, diagonal))
    x, y, diagonal = x[order], y[order], diagonal[order]
    new = np.ones(len(x), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (x[1:] - x[:-1] > K + SPREAD)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(x)) - 1
    out = np.column_stack((x[start], y[start], x[end] - x[start] + K))
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def chains(parts: np.ndarray) -> list[list[int]]:
    """Disjoint chains of segments, best first, by a tree of range maxima.

    With a cost of GAP_COST per word of gap in either document, the score of a chain that ends in j
    and goes on at i is score(j) - GAP_COST * (x_i + y_i - end of j in x and y), so the tree holds
    score(j) + GAP_COST * (ends of j) at the place of j's end in y.  A segment enters the tree when
    the sweep over x has passed its end and leaves it MOST_GAP words later, and only ends in y within
    MOST_GAP are asked for, so a far predecessor never hides a near one.
    """
    n = len(parts)
    x, y, w = parts[:, 0].tolist(), parts[:, 1].tolist(), parts[:, 2].tolist()
    by_end = sorted(range(n), key=lambda i: y[i] + w[i])
    ends = [y[i] + w[i] for i in by_end]
    leaf = [0] * n
    for k, i in enumerate(by_end):
        leaf[i] = k + n
    none = (-1e18, -1)
    tree: list[tuple[float, int]] = [none] * (2 * n)
    score, back = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: x[i] + w[i])
    done = gone = 0

    def put(j: int, value: tuple[float, int]) -> None:
        k = leaf[j]
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = max(tree[2 * k], tree[2 * k + 1])

    for i in range(n):
        while done < n and x[waiting[done]] + w[waiting[done]] <= x[i]:
            j = waiting[done]
            done += 1
            put(j, (score[j] + GAP_COST * (x[j] + w[j] + y[j] + w[j]), j))
        while gone < done and x[waiting[gone]] + w[waiting[gone]] < x[i] - MOST_GAP:
            put(waiting[gone], none)
            gone += 1
        best = none
        low, high = bisect_left(ends, y[i] - MOST_GAP) + n, bisect_right(ends, y[i]) + n
        while low < high:
            if low & 1:
                best = max(best, tree[low])
                low += 1
            if high & 1:
                high -= 1
                best = max(best, tree[high])
            low >>= 1
            high >>= 1
        gain, j = best[0] - GAP_COST * (x[i] + y[i]), best[1]
        if j >= 0 and gain > 0:
            score[i], back[i] = w[i] + gain, j
        else:
            score[i] = float(w[i])
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _matched(a: list[int], b: list[int]) -> int:
    """Words in common of an optimal alignment of two gaps, by a row of bits for each word of one."""
    if not a or not b:
        return 0
    place: dict[int, int] = {}
    for k, word in enumerate(b):
        place[word] = place.get(word, 0) | 1 << k
    all_places = row = (1 << len(b)) - 1
    for word in a:
        here = row & place.get(word, 0)
        if here:
            row = (row + here | row - here) & all_places
    return len(b) - row.bit_count()


def _extension(a: list[int], b: list[int], x: int, y: int, step: int) -> tuple[int, int]:
    """Words to go on from x and y of both, forward or back, and how many of them agree."""
    n = min(len(a) - x, len(b) - y) if step > 0 else min(x, y)
    if step < 0:
        x, y = x - 1, y - 1
    score = best = size = same = agree = 0
    for k in range(n):
        if a[x + step * k] == b[y + step * k]:
            agree += 1
            score += 1
            if score > best:
                best, size, same = score, k + 1, agree
        else:
            score -= 1
            if best - score > DROP:
                break
    return size, same


def align(chain: list[list[int]], a: list[int], b: list[int], ends: dict[tuple[int, int, int], tuple[int, int]]
          ) -> tuple[int, int, int, int, int] | None:
    """begin and end in both documents, and the words in common, of an extended chain; None if it is too short.

    `ends` keeps extensions: parts of a chain share them.
    """

    def extension(x: int, y: int, step: int) -> tuple[int, int]:
        if (got := ends.get((x, y, step))) is None:
            got = ends[x, y, step] = _extension(a, b, x, y, step)
        return got

    x, y, _ = chain[0]
    u, v, w = chain[-1]
    back, same = extension(x, y, -1)
    more, also = extension(u + w, v + w, 1)
    span = (x - back, u + w + more, y - back, v + w + more)
    if min(span[1] - span[0], span[3] - span[2]) < LEAST_WORDS:
        return None
    matched, at = same + also, (x, y)
    for x, y, w in chain:
        if at != (x, y):
            matched += _matched(a[at[0] : x], b[at[1] : y])
        # Seeds of a segment cover all but short stretches between them.
        matched += w if a[x : x + w] == b[y : y + w] else sum(map(eq, a[x : x + w], b[y : y + w]))
        at = (x + w, y + w)
    return *span, matched


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of at least two linked seeds of each pair of documents."""
    for batch in batches:
        out = {"a": [], "b": [], "chains": []}
        links = batch.column("links")
        offsets = links.offsets.to_pylist()
        every_at, every_bt = (links.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "bt"))
        for a, b, begin, end in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), offsets, offsets[1:]):
            if end - begin < 2:  # one seed is no chain
                continue
            parts = segments(every_at[begin:end], every_bt[begin:end])
            found = [parts] if len(parts) == 1 else [parts[c] for c in chains(parts)]
            found = [c for c in found if c[:, 2].sum() > K]
            if found:
                out["a"].append(a)
                out["b"].append(b)
                out["chains"].append([c.ravel() for c in found])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()), pa.array(out["chains"], pa.list_(pa.list_(pa.int64())))],
            names=["a", "b", "chains"],
        )


def rematched(a: np.ndarray, b: np.ndarray, line: np.ndarray, seen: np.ndarray, low: int, high: int, cut: int = 0, stop: int | None = None
              ) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of equal numbers of a and b with low <= x - y <= high, x from `cut`, y before `stop`.

    `line` has the sorted `number << 32 | place` of b, `seen` a false value for each number, as it has afterwards.
    """
    seen[b] = True
    x = np.flatnonzero(seen[a[cut:]]) + cut
    seen[b] = False
    last = x - low if stop is None else np.minimum(x - low, stop - 1)
    x, last = x[last >= 0], last[last >= 0]
    base = a[x] << 32
    begin = np.searchsorted(line, base | np.maximum(x - high, 0))
    n = np.maximum(np.searchsorted(line, base | last, "right") - begin, 0)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(x, n), line[np.repeat(begin, n) + offset] & 0xFFFFFFFF


def _passages(chain: list[list[int]], a: list[int], b: list[int], ends: dict) -> list[tuple[int, int, int, int, int]]:
    """The chain's passage, or those of its parts on both sides of its widest gap."""
    span = align(chain, a, b, ends)
    if span is None:
        return []
    if span[4] >= IDENTITY * max(span[1] - span[0], span[3] - span[2]):
        return [span]
    if len(chain) == 1:
        return []
    gaps = [p[0] - q[0] + p[1] - q[1] - 2 * q[2] for p, q in zip(chain[1:], chain)]
    cut = gaps.index(max(gaps)) + 1
    return _passages(chain[:cut], a, b, ends) + _passages(chain[cut:], a, b, ends)


def _bands(found: list[list[int]], a: list[int], b: list[int], own: bool) -> list[tuple[int, int, int]]:
    """Least and greatest diagonal to match, and where one text is cut if both places are in it."""
    out = []
    for chain in found:
        d = [x - y for x, y in zip(chain[::3], chain[1::3])]
        cut = 0
        if own:
            x, y = chain[:2]
            most = min(max(x - chain[-2] - chain[-1], 0), x, y)
            cut = x - next((k for k in range(most) if a[x - 1 - k] != b[y - 1 - k]), most)
        out.append((cut, min(d) - BAND, max(d) + BAND))
    merged: list[tuple[int, int, int]] = []
    for cut, low, high in sorted(out):
        if merged and merged[-1][0] == cut and low <= merged[-1][2]:
            merged[-1] = (cut, merged[-1][1], max(high, merged[-1][2]))
        else:
            merged.append((cut, low, high))
    return merged


def _pair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[int], list[int]]]:
    """Slices of pairs with about BLOCK_BYTES of distinct texts, these texts, and the places of both sides among them.

    Pairs come by their longer document, so its text is next to itself.
    """
    for batch in batches:
        sides = [batch.column(c).cast(pa.binary()) for c in ("left", "right")]
        texts: dict[bytes, int] = {}
        places: list[list[int]] = [[], []]
        start = size = 0
        for k in range(batch.num_rows):
            for side, place in zip(sides, places):
                text = side[k].as_py() or b""
                if text not in texts:
                    size += len(text)
                place.append(texts.setdefault(text, len(texts)))
            if size >= BLOCK_BYTES or k + 1 == batch.num_rows:
                yield batch.slice(start, k + 1 - start), list(texts), *places
                start, size, texts, places = k + 1, 0, {}, [[], []]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("a_begin", "a_end", "b_begin", "b_end", "matched")
    for batch, texts, left, right in _pair_blocks(batches):
        block = Block(texts, LOWER)
        words = block.word_hashes()
        ids, first = block.shingles(K)
        begin = np.searchsorted(first, block.first_word)
        end = np.searchsorted(first, block.first_word + block.n_words)
        _, run = np.unique(ids, return_inverse=True)
        seen = np.zeros(len(ids), bool)
        known: dict[int, tuple[list[int], np.ndarray]] = {}
        lines: dict[int, np.ndarray] = {}

        def of(k: int) -> tuple[list[int], np.ndarray]:
            if k not in known:
                known[k] = words[block.first_word[k] : block.first_word[k] + block.n_words[k]].tolist(), run[begin[k] : end[k]].astype(np.int64)  # noqa: B023
            return known[k]

        def line(k: int) -> np.ndarray:
            if k not in lines:
                lines[k] = np.sort(of(k)[1] << 32 | np.arange(len(of(k)[1])))
            return lines[k]

        rows, keep = [], []
        pairs = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "chains")))
        for k, (a_node, b_node, found) in enumerate(pairs):
            (a, a_runs), (b, b_runs) = of(left[k]), of(right[k])
            own, spans = a_node == b_node, []
            for at, low, high in _bands(found, a, b, own):
                stop = at if own else len(b)
                if own:
                    x, y = rematched(a_runs, b_runs, line(right[k]), seen, low, high, at, max(stop - K + 1, 0))
                elif len(a) > len(b):  # the longer one is in more pairs
                    y, x = rematched(b_runs, a_runs, line(left[k]), seen, -high, -low)
                else:
                    x, y = rematched(a_runs, b_runs, line(right[k]), seen, low, high)
                if not len(x):
                    continue
                parts = segments(x - at, y)
                whole, (one, two), ends = parts.tolist(), (a[at:], b[:stop]), {}
                for chain in chains(parts):
                    for s in _passages([whole[i] for i in chain], one, two, ends):
                        spans.append((s[0] + at, s[1] + at, *s[2:]))
            last = -1
            for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2:])):
                if s[1] > last:
                    rows.append(s)
                    keep.append(k)
                    last = s[1]
        table = np.array(rows, np.int64).reshape(-1, 5)
        some = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(table[:, k]) for k in range(5)]], names=["a", "b", *fields])


def _with_texts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, chains and the texts `left` and `right` of pairs: the shorter one travels with its pair to
    the longer one, which moves once however many pairs it is in."""
    size = lambda c: texts.select(F.col("node").alias(c), F.octet_length("text").alias(f"size_{c}"))
    a_first = F.coalesce("size_a", F.lit(0)) <= F.coalesce("size_b", F.lit(0))
    sized = found.join(size("a"), "a").join(size("b"), "b").select(
        "a", "b", "chains", a_first.alias("a_first"), F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("short"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("long"),
    )
    both = sized.join(texts.select(F.col("node").alias("short"), F.col("text").alias("one")), "short")
    both = both.join(texts.select(F.col("node").alias("long"), F.col("text").alias("two")), "long")
    return both.select(
        "a", "b", "chains", F.when(F.col("a_first"), F.col("one")).otherwise(F.col("two")).alias("left"),
        F.when(F.col("a_first"), F.col("two")).otherwise(F.col("one")).alias("right"),
    )


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES: ten thousand pairs of texts, their arrays and copies are hundreds of MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, end (words), other_id, other_begin, other_end, matched (words in common).

    One row for each passage of a document and a partner that has it before.
    """
    rows = identified(docs, id_col, text_col)
    node = node_of()
    texts = rows.select(node.alias("node"), "id", "text")
    occurrences = texts.select("node", "text").mapInArrow(_seed_rows, "seed long, node long, at int")
    by_seed = Window.partitionBy("seed").orderBy("node", "at")
    first = F.first(F.struct("node", "at")).over(by_seed)
    held = occurrences.withColumn("first", first).withColumn("next", F.lead("at").over(by_seed))
    is_first = (F.col("first.node") == F.col("node")) & (F.col("first.at") == F.col("at"))
    held = held.filter(~is_first | F.col("next").isNotNull())
    # A document's held seeds are bounded by its words, and so are a pair's links.
    place = F.struct("at", "seed", F.col("first.node").alias("b"), F.col("first.at").alias("bt"))
    of_doc = held.groupBy("node").agg(F.collect_list(place).alias("held"))
    links = of_doc.mapInArrow(_seed_links, "a long, b long, at int, bt int")
    twos = of_doc.mapInArrow(_seed_pairs, "key long, node long, at int, to int")
    by_two = Window.partitionBy("key").orderBy("node", "at", "to")
    twos = twos.withColumn("first", F.first(F.struct("node", "at", "to")).over(by_two))
    apart = (F.col("first.node") != F.col("node")) | (F.col("at") - F.col("first.to") >= K)
    twos = twos.filter(apart).select(
        F.col("node").alias("a"), F.col("first.node").alias("b"),
        F.inline(F.array(
            F.struct(F.col("at"), F.col("first.at").alias("bt")), F.struct(F.col("to").alias("at"), F.col("first.to").alias("bt")),
        )),
    )
    paired = links.unionByName(twos).groupBy("a", "b").agg(F.collect_set(F.struct("at", "bt")).alias("links"))
    found = write_and_read(paired.mapInArrow(_chained, "a long, b long, chains array<array<long>>"), "chains")
    text = write_and_read(_mostly_of(texts, found.selectExpr("explode(array(a, b)) as node")), "chain-texts")
    whole = _with_texts(found, text)
    schema = "a long, b long, a_begin long, a_end long, b_begin long, b_end long, matched long"
    with _small_batches(docs.sparkSession):
        passages = write_and_read(whole.mapInArrow(_aligned, schema), "passages")
    if_tied = rows.filter("tie <> 0").select(node.alias("node"), "id")
    named = passages.join(if_tied.select(F.col("node").alias("a"), F.col("id").alias("a_id")), "a", "left")
    named = named.join(if_tied.select(F.col("node").alias("b"), F.col("id").alias("b_id")), "b", "left")

    def shown(tied: str, plain: str):
        return F.when(F.coalesce(tied, plain) != NULL_ID, F.coalesce(tied, plain))

    return named.select(
        shown("a_id", "a").alias(id_col), F.col("a_begin").alias("begin"), F.col("a_end").alias("end"),
        shown("b_id", "b").alias("other_id"), F.col("b_begin").alias("other_begin"), F.col("b_end").alias("other_end"), "matched",
    )

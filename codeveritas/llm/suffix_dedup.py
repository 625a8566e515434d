"""Substring dedup over the sorted suffixes of all documents, by bucket-pointer refinement.

A string of LENGTH bytes is removed where it starts a second time, in order of (document, offset).
The suffixes are those of the whole corpus; they are never sorted to the end, only until no bucket
mixes suffixes that agree and suffixes that differ in what decides a removal:

1. Suffixes start in buckets of equal Q-grams.  Bucket identifiers of longer prefixes come from the
   identifiers at later offsets, 8 -> 16 -> 32 -> 64 bytes, each round reading what the last one
   updated (`qgrams`), so every task gives equal strings equal identifiers.
2. Of each window of LENGTH bytes one suffix is exchanged: the one with the least Q-gram identifier,
   the first of equals.  It depends on the window's content alone, so equal windows meet in one
   bucket.  A row stands for all successive windows that choose the same suffix.
3. Buckets are sorted by the identifier of all the bytes those windows cover.  Rows that agree with
   an earlier row are removed as a whole; a bucket with one identifier only is done.
4. Mixed buckets are refined: their windows in groups of eight, by the identifier of the bytes
   common to the eight (a bucket of one is done) and then of all their bytes; groups that are
   neither done nor equal to an earlier one, window by window.

Every task first settles what its own rows decide, so an exchange gets one row per task of a hot
string.  Documents are moved by one exchange that all joins reuse; removed runs travel narrow.

Identifiers of 2 x 64 bits name a string in each decision.

Defined results: null text is empty; text below LENGTH bytes loses nothing; rows that share an id,
null ids, and repeated rows follow `base.identified`; an empty table gives an empty result; other
columns are returned only where named in `carry`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .base import blocks, identified, original_id
from .qgrams import doubled, eight_grams, joined, pair, sliding

#: Bytes of a repeated string, and of the q-grams of the first buckets.
LENGTH = 100
Q = 32
WINDOWS = LENGTH - Q + 1

#: Windows refined together, and bytes of a long text handled at a time.
GROUP = 8
PIECE = 4_000_000

_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
RUN, SUFFIX, WINDOW_RANGE = 1, 0, 2

ROWS = "kind int, key long, id1 long, id2 long, id long, tie long, at long, n long, spans array<struct<a:long,b:long>>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def pieces(text: bytes, windows: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """Parts of a text, each with the bytes of the next `windows` windows, and their offsets."""
    if len(text) <= windows + LENGTH:
        yield 0, text
        return
    for base in range(0, len(text) - LENGTH + 1, windows):
        yield base, text[base : base + windows + LENGTH - 1]


def chosen_suffixes(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each text, the suffixes that its windows choose: (text, first window, last window, offset,
    Q-gram identifier, identifier of all bytes of these windows)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(buffer) < LENGTH:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    ids = doubled(doubled(eight_grams(buffer), 8), 16)
    deep = doubled(ids, 32)
    # Offsets whose Q-gram leaves its text never win; windows that leave theirs do not choose.
    outside = np.zeros(len(buffer) + 1, np.int32)
    np.add.at(outside, np.maximum(ends - Q + 1, starts), 1)
    np.add.at(outside, ends, -1)
    outside = np.cumsum(outside)[: len(ids)] > 0
    ids[outside] = _MOST
    within = np.zeros(len(buffer) + 1, np.int32)
    np.add.at(within, starts, 1)
    np.add.at(within, np.maximum(ends - LENGTH + 1, starts), -1)
    least = sliding(ids, WINDOWS)
    least[np.cumsum(within)[: len(least)] <= 0] = 0
    edge = np.zeros(WINDOWS - 1, np.uint64)
    best = sliding(np.concatenate((edge, least, edge)), WINDOWS, np.maximum)[: len(ids)]
    at = np.flatnonzero((best == ids) & ~outside)
    own = ids[at]
    low, high = at - (WINDOWS - 1), at.copy()
    k = 1
    while k < len(at):
        near = at[k:] - at[:-k] < WINDOWS
        if not near.any():
            break
        np.copyto(low[k:], np.maximum(low[k:], at[:-k] + 1), where=near & (own[:-k] <= own[k:]))
        np.copyto(high[:-k], np.minimum(high[:-k], at[k:] - WINDOWS), where=near & (own[k:] < own[:-k]))
        k += 1
    text = np.searchsorted(ends, at, side="right")
    low, high = np.maximum(low, starts[text]), np.minimum(high, ends[text] - LENGTH)
    keep = low <= high
    text, low, high, at, own = text[keep], low[keep], high[keep], at[keep], own[keep]
    whole = joined(deep, 64, low, high - low + LENGTH)
    return text, low - starts[text], high - starts[text], at - starts[text], own, whole


def later(ids: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Rows for which an equal row (in all `ids`) is earlier in `order`."""
    rank = np.lexsort((*reversed(order), *reversed(ids)))
    same = np.ones(max(0, len(rank) - 1), bool)
    for x in ids:
        same &= x[rank[1:]] == x[rank[:-1]]
    out = np.zeros(len(rank), bool)
    out[rank[1:]] = same
    return out


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as sorted maximal intervals."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[new], end[np.concatenate((new[1:] - 1, [len(end) - 1]))]


def _batch(kind, key, id1, id2, ids, tie, at, n, spans=None) -> pa.RecordBatch:
    size = len(at)
    full = lambda x: np.full(size, x, np.int64) if np.isscalar(x) else np.asarray(x).astype(np.uint64, copy=False).view(np.int64)
    plain = lambda x: np.full(size, x, np.int64) if np.isscalar(x) else np.asarray(x, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(plain(kind).astype(np.int32)), pa.array(full(key)), pa.array(full(id1)), pa.array(full(id2)),
         pa.array(plain(ids)), pa.array(plain(tie)), pa.array(plain(at)), pa.array(plain(n)),
         pa.nulls(size, _SPANS) if spans is None else pa.array(spans, _SPANS)],
        names=["kind", "key", "id1", "id2", "id", "tie", "at", "n", "spans"],
    )


def _runs(ids, tie, first, last) -> pa.RecordBatch:
    """Removed runs of windows [first, last], merged for each document."""
    rank = np.lexsort((first, tie, ids))
    ids, tie, first, last = ids[rank], tie[rank], first[rank], last[rank]
    same = (ids[1:] == ids[:-1]) & (tie[1:] == tie[:-1]) & (first[1:] <= last[:-1] + 1)
    new = np.flatnonzero(np.concatenate(([True], ~same))) if len(ids) else np.zeros(0, np.int64)
    last = np.maximum.reduceat(last, new) if len(new) else last
    ids, tie, first = ids[new], tie[new], first[new]
    return _batch(RUN, ids, 0, 0, ids, tie, first, last - first + 1)


def _first_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        found = []
        for batch, texts in blocks(iter([whole])):
            ids, tie = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
            parts = [(k, base, part) for k, t in enumerate(texts) if len(t) >= LENGTH for base, part in pieces(t)]
            if not parts:
                continue
            doc, base = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
            part, low, high, at, key, cover = chosen_suffixes([p[2] for p in parts])
            shift = base[part]
            found.append((key, cover, ids[doc[part]], tie[doc[part]], low + shift, high - low, at - high))
        if not found:
            continue
        key, cover, ids, tie, low, n, back = (np.concatenate(x) for x in zip(*found))
        gone = later([key, cover], [ids, tie, low])
        left = ~gone
        yield _batch(SUFFIX, key[left], cover[left], 0, ids[left], tie[left], low[left], (n * 128 + back)[left])
        if gone.any():
            yield _runs(ids[gone], tie[gone], low[gone], (low + n)[gone])


def _prepare(texts: list[bytes], wanted: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Q-gram identifiers of the parts of texts near the wanted offsets: (32-gram and 64-gram ids,
    offset of the part, places in `wanted`)."""
    for k, (text, offsets) in enumerate(zip(texts, wanted)):
        if not len(offsets):
            continue
        part = offsets // PIECE
        for p in np.unique(part):
            base = max(0, int(p) * PIECE - 2 * LENGTH)
            buffer = np.frombuffer(text[base : (int(p) + 1) * PIECE + 4 * LENGTH], np.uint8)
            ids = doubled(doubled(eight_grams(buffer), 8), 16)
            yield k, ids, doubled(ids, 32), base, np.flatnonzero(part == p)


def _lists(column: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of one field of a list column of structs, and the row of each."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    values = flat.field(field).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
    return values, np.repeat(np.arange(len(column)), sizes)


def _spans_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bytes removed so far from each document of a batch, as merged intervals."""
    a, row = _lists(batch.column("runs"), "at")
    n, _ = _lists(batch.column("runs"), "n")
    begin, end, rows = [a], [a + n - 1 + LENGTH], [row]
    if "spans" in batch.schema.names:
        a, row = _lists(batch.column("spans"), "a")
        b, _ = _lists(batch.column("spans"), "b")
        begin, end, rows = [*begin, a], [*end, b], [*rows, row]
    begin, end, rows = (np.concatenate(x).astype(np.int64) for x in (begin, end, rows))
    order = np.argsort(rows, kind="stable")
    cuts = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
    return [merged(begin[o], end[o]) for o in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]


def _span_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, tie = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
    spans = [[{"a": int(a), "b": int(b)} for a, b in zip(*s)] for s in _spans_of(batch)]
    some = np.array([bool(s) for s in spans])
    return _batch(RUN, ids[some], 0, 0, ids[some], tie[some], np.zeros(some.sum(), np.int64), 0, [s for s in spans if s])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of mixed buckets in groups of GROUP."""
    for batch, texts in blocks(batches):
        yield _span_rows(batch)
        ids, tie = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
        low, row = _lists(batch.column("open"), "at")
        code, _ = _lists(batch.column("open"), "n")
        key, _ = _lists(batch.column("open"), "key")
        high = low + code // 128
        at = high + code % 128
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        out = []
        wanted = [at[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for k, _, deep, base, places in _prepare(texts, wanted):
            mine = cuts[k] + places
            near, far = (at - high)[mine] // GROUP, (at - low)[mine] // GROUP
            times = far - near + 1
            owner = np.repeat(mine, times)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(near, times)
            first = at[owner] - step * GROUP - (GROUP - 1)
            # At the ends of a text a group has fewer windows, but all contain the common bytes.
            begin = np.maximum(first, 0)
            n = np.minimum(first + GROUP - 1, len(texts[k]) - LENGTH) - begin + 1
            some = n > 0
            first, begin, n, owner = first[some], begin[some], n[some], owner[some]
            common = joined(deep, 64, first + GROUP - 1 - base, LENGTH - GROUP + 1)
            cover = joined(deep, 64, begin - base, n + LENGTH - 1) + ((begin - first) * GROUP + n).astype(np.uint64)
            out.append((key[owner].view(np.uint64), common, cover, np.full(len(first), k), begin, n))
        if out:
            key, common, cover, k, first, n = (np.concatenate(x) for x in zip(*out))
            gone = later([key, common, cover], [ids[k], tie[k], first])
            left = ~gone
            yield _batch(SUFFIX, key[left], common[left], cover[left], ids[k][left], tie[k][left], first[left], n[left])
            if gone.any():
                yield _runs(ids[k][gone], tie[k][gone], first[gone], (first + n - 1)[gone])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that are still open, one by one."""
    for batch, texts in blocks(batches):
        yield _span_rows(batch)
        ids, tie = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
        at, row = _lists(batch.column("open"), "at")
        n, _ = _lists(batch.column("open"), "n")
        at = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(row, n)
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        wanted = [np.unique(at[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        out = []
        for k, ids32, deep, base, places in _prepare(texts, wanted):
            first = wanted[k][places]
            p = first - base
            one = joined(deep, 64, p, LENGTH)
            two = pair(pair(ids32[p], ids32[p + 32]), pair(ids32[p + 64], ids32[p + LENGTH - 32]))
            out.append((one, two, np.full(len(p), k), first))
        if out:
            one, two, k, first = (np.concatenate(x) for x in zip(*out))
            gone = later([one, two], [ids[k], tie[k], first])
            left = ~gone
            yield _batch(SUFFIX, one[left], two[left], 0, ids[k][left], tie[k][left], first[left], 1)
            if gone.any():
                yield _runs(ids[k][gone], tie[k][gone], first[gone], first[gone])


def _sorted_buckets(rows: DataFrame, bucket: list[str], then: str | None) -> DataFrame:
    """Sorts each bucket by `then` and place: rows equal to the one before become runs; first rows
    stay open where the bucket has several values of `then`; all others are done."""
    rows = rows.repartition("key")
    keys = ["kind", *bucket]
    order = [*([then] if then else []), "id", "tie", "at"]
    sorted_ = Window.partitionBy(*keys).orderBy(*order)
    if then is None:
        rows = rows.withColumn("gone", F.row_number().over(sorted_) > 1).withColumn("mixed", F.lit(False))
    else:
        everything = sorted_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("gone", F.coalesce(F.lag(then).over(sorted_) == F.col(then), F.lit(False)))
        rows = rows.withColumn("mixed", F.min(then).over(everything) != F.max(then).over(everything))
    suffix = F.col("kind") == SUFFIX
    rows = rows.withColumn("gone", F.col("gone") & suffix)
    kind = F.when(~suffix, F.col("kind")).when(F.col("gone"), RUN).when(F.col("mixed"), WINDOW_RANGE)
    return rows.withColumn("kind", kind).filter("kind is not null")


def _by_document(rows: DataFrame, packed: bool) -> DataFrame:
    """One row a document: its removed runs and what is still open.  Bounded by its length.

    `packed`: n of a suffix row holds its number of windows and its offset too.
    """
    if packed:
        # A run of suffix rows counts windows from here on; those that came as runs already do.
        rows = rows.withColumn(
            "n", F.when((F.col("kind") == RUN) & F.col("gone"), F.floor(F.col("n") / 128) + 1).otherwise(F.col("n"))
        )
    run, is_open = F.col("kind") == RUN, F.col("kind") == WINDOW_RANGE
    return rows.groupBy("id", "tie").agg(
        F.collect_list(F.when(run & F.col("spans").isNull(), F.struct("at", "n"))).alias("runs"),
        F.collect_list(F.when(is_open, F.struct("at", "n", "key"))).alias("open"),
        F.flatten(F.collect_list(F.when(run, F.col("spans")))).alias("spans"),
    )


def duplicate_runs(rows: DataFrame) -> DataFrame:
    """id, tie, runs, spans: what is removed from each row of `base.identified` that loses bytes."""
    texts = rows.select("id", "tie", "text")
    state = _by_document(_sorted_buckets(texts.mapInArrow(_first_buckets, ROWS), ["key"], "id1"), packed=True)
    # Written, so that the rows of the first buckets leave the disk before the texts are exchanged.
    state = write_and_read(state, "suffix-state")
    for step, bucket, then in ((_grouped, ["key", "id1"], "id2"), (_single, ["key", "id1"], None)):
        joined_ = texts.join(state, ["id", "tie"]).select(
            "id", "tie", F.when(F.size("open") > 0, F.col("text")).alias("text"), "runs", "open", "spans"
        )
        state = _by_document(_sorted_buckets(joined_.mapInArrow(step, ROWS), bucket, then), packed=False)
    return state.select("id", "tie", "runs", "spans")


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, with_text: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans; the remaining text if asked for.

    Remaining text drops the bytes of characters that a removal has cut; the digest does not.
    """
    rows = identified(docs, id_col, text_col, carry)
    # All joins with texts read the same three columns, so Spark exchanges the texts once.
    texts = rows.select("id", "tie", "text")
    found = texts.join(duplicate_runs(texts), ["id", "tie"], "left")
    if carry:
        found = found.join(rows.select("id", "tie", "carried"), ["id", "tie"])
    schema = "id long, {carried} n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>> {text}"
    carried = f"carried {rows.schema['carried'].dataType.simpleString()}," if carry else ""
    schema = schema.format(carried=carried, text=", text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text")}
            for text, (begin, end) in zip(texts, _spans_of(batch)):
                cuts = [0, *np.column_stack((begin, end)).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(begin))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"a": a, "b": b} for a, b in zip(cuts[1:-1:2], cuts[2:-1:2])])
                out["text"].append(kept.decode("utf-8", "ignore") if with_text else None)
            columns = [batch.column("id"), *([batch.column("carried")] if carry else [])]
            columns += [pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")]
            columns += [pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], _SPANS)]
            columns += [pa.array(out["text"], pa.string())] if with_text else []
            names = ["id", *(["carried"] if carry else []), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(["text"] if with_text else [])])

    wanted = ["id", *(["carried"] if carry else []), "text", "runs", "spans"]
    out = original_id(found.select(*wanted).mapInArrow(run, schema))
    kept = [c for c in out.columns if c not in ("id", "carried")]
    names = [F.col(f"carried.`{c}`") for c in carry or [] if c not in kept]
    return out.select(F.col("id").alias(id_col), *names, *kept)

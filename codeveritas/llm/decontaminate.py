"""Benchmark decontamination: an Aho-Corasick automaton over normalised benchmark windows.

Text is normalised to lower-case words joined by single spaces; the automaton holds every window
of `width` consecutive words of every item, and an item of fewer words as one window.  Each text is
scanned once; matches are mapped back to word numbers and to byte offsets of the original text.

Defined results: null or wordless text has no words and is clean; null, empty or wordless items
match nothing; items that share an id count as one; documents keep one row each, repeated rows and
shared or null ids included; other columns of either table are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import blocks

WIDTH = 10

#: Benchmark text in one automaton; a larger benchmark is dealt into several, scanned in turn.
AUTOMATON_BYTES = 16_000_000

_WORD = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _WORD[b] else 32 for b in range(256))
_IS_WORD = np.array(_WORD)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def build(items: list[tuple[int, bytes]], width: int):
    """The automaton; each pattern carries its number of words and the places of its items."""
    import ahocorasick

    found: dict[str, tuple[int, list[int]]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            key = (b" " + b" ".join(words[i : i + n]) + b" ").decode("latin-1")
            owners = found.setdefault(key, (n, []))[1]
            if not owners or owners[-1] != item:
                owners.append(item)
    automaton = ahocorasick.Automaton()
    for key, (n, owners) in found.items():
        automaton.add_word(key, (n, tuple(owners)))
    if found:
        automaton.make_automaton()
    return automaton if found else None


def _offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of a text start and end."""
    inside = np.concatenate(([False], _IS_WORD[np.frombuffer(text, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def scan(text: bytes, automaton) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, numbers of the hit words, ids of the items found."""
    words = words_of(text)
    hit, items = np.zeros(0, np.int64), set()
    if automaton is None or not words:
        return len(words), hit, items
    line = " " + b" ".join(words).decode("latin-1") + " "
    ends, lengths = [], []
    for end, (n, owners) in automaton.iter(line):
        ends.append(end)
        lengths.append(n)
        items.update(owners)
    if ends:
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(gaps, np.array(ends))
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, last - np.array(lengths), 1)
        np.add.at(cover, last, -1)
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    return len(words), hit, items


def _scanner(items: list[tuple[int, bytes]], width: int, last: bool):
    schema_found = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(items, width)
        for batch, texts in blocks(batches):
            out = {k: [] for k in ("n_words", "hit", "items", "spans")}
            before = zip(batch.column("hit").to_pylist(), batch.column("items").to_pylist())
            for text, (old_hit, old_items) in zip(texts, before):
                n, hit, ids = scan(text, automaton)
                hit = np.union1d(hit, old_hit).astype(np.int64) if old_hit else hit
                out["n_words"].append(n)
                out["hit"].append(hit)
                out["items"].append(sorted(ids.union(old_items)))
                spans = []
                if last and len(hit):
                    starts, ends = _offsets(text)
                    cut = np.flatnonzero(np.diff(hit) > 1)
                    spans = [
                        {"start": int(starts[a]), "end": int(ends[b])}
                        for a, b in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]])
                    ]
                out["spans"].append(spans)
            columns = [batch.column(c) for c in batch.schema.names[: batch.num_columns - 4]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out["n_words"], pa.int64()), pa.array(out["hit"], schema_found),
                 pa.array(out["items"], schema_found),
                 pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=batch.schema.names,
            )

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int
                     ) -> list[list[tuple[int, bytes]]]:
    """The items in blocks of about `limit` bytes; each block is collected by itself."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    items = items.filter("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    out = []
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else items
        rows = sorted((r.item, (r.text or "").encode()) for r in block.collect())
        out.append(rows)
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    block_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """`docs` with n_words, hit (numbers of hit words), items (ids found) and spans (byte offsets).

    Its own columns of these names are replaced.  One narrow map: no exchange.
    """
    extra = "n_words long, hit array<long>, items array<long>, spans array<struct<start:long,end:long>>"
    names = ("n_words", "hit", "items", "spans")
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(
        *[F.col(f"`{c}`").cast("string").alias("text") if c == text_col else F.col(f"`{c}`") for c in kept],
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("hit"),
        F.array().cast("array<long>").alias("items"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
    )
    parts = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    for k, items in enumerate(parts):
        rows = rows.mapInArrow(_scanner(items, width, k == len(parts) - 1), rows.schema)
    return rows.withColumnRenamed("text", text_col)


def item_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def digest_column(items: str = "items"):
    """item_digest() as a column."""
    return F.sha2(F.array_join(F.array_sort(F.col(items).cast("array<string>")), ","), 256)

"""Quoted CSV read in chunks, wherever line breaks stand inside quotes.

A quote toggles between inside and outside (a doubled quote toggles twice), so what a chunk of bytes
does to the state depends on the parity of its quotes alone.  A first pass counts quotes of every
chunk, a prefix sum over these narrow rows gives the state in which every chunk begins, and a second
pass cuts records: a chunk owns the records that begin in it, and reads on past its end to finish the
last one.  One large file so becomes many tasks, like many small ones.

Storage is what `sources.directories` opens.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .directories import list_tree, open_root

# Workers get these modules by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a chunk, and of a read past its end; bytes of records in an Arrow batch.
CHUNK_BYTES, STEP_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 4 << 20, 500

_QUOTE, _BREAK, _RETURN = b'"'[0], b"\n"[0], b"\r"[0]


def _chunks(spark: SparkSession, root: str, chunk_bytes: int) -> DataFrame:
    """path, size, start of every chunk of every file below `root`, or of the file `root` itself."""
    store, base = open_root(root)
    info = store.get_file_info(base)
    if info.is_file:
        parent, _, name = root.rstrip("/").rpartition("/")
        files = spark.createDataFrame([(name, info.size)], "path string, size bigint")
    else:
        # Names of hidden and marker files are not data.
        files = list_tree(spark, root).where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]")).select("path", "size")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk_bytes).cast("bigint"))
    return files.where("size > 0").select("path", "size", F.explode(starts).alias("start"))


def record_ends(data: np.ndarray, inside: bool) -> np.ndarray:
    """Places after the line breaks of `data` that end a record, if it begins inside quotes or not."""
    quotes = np.cumsum(data == _QUOTE, dtype=np.int64)
    breaks = data == _BREAK
    # A carriage return alone ends a record too; before a line feed the feed does.
    lone = data == _RETURN
    lone[:-1] &= data[1:] != _BREAK
    if len(lone):
        lone[-1] = False
    at = np.flatnonzero(breaks | lone)
    return at[(quotes[at] + inside) % 2 == 0] + 1


def read_csv(
    spark: SparkSession, root: str, columns: list[str], chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """The named columns, as strings, of CSV files with a header line each.

    Quotes are ``"``, around whole fields, doubled inside quotes.  Fields that are empty without quotes
    are null, as are those past the end of a short record; blank lines are no records.
    """
    base_root = root.rstrip("/")
    store, base = open_root(root)
    if store.get_file_info(base).is_file:
        base_root = base_root.rpartition("/")[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(base_root)
        for batch in batches:
            quotes = []
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                total = 0
                with store.open_input_file(f"{base}/{path}") as file:
                    for at in range(start, min(start + chunk_bytes, file.size()), STEP_BYTES):
                        file.seek(at)
                        total += file.read(min(STEP_BYTES, start + chunk_bytes - at)).count(b'"')
                quotes.append(total)
            yield pa.record_batch([*batch.select(["path", "start"]).columns, pa.array(quotes, pa.int64())], names=["path", "start", "quotes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(base_root)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['path']}") as file:
                    yield from _records(file, row["start"], chunk_bytes, bool(row["inside"]), columns)

    chunks = _chunks(spark, root, chunk_bytes).repartition(4 * spark.sparkContext.defaultParallelism, "path", "start")
    counted = chunks.select("path", "start").mapInArrow(count, "path string, start bigint, quotes bigint")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = counted.select("path", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"))
    schema = ", ".join(f"`{c}` string" for c in columns)
    return state.repartition(4 * spark.sparkContext.defaultParallelism, "path", "start").mapInArrow(read, schema)


def _blocks(file, at: int, inside: bool, size: int) -> Iterator[tuple[int, bytes, np.ndarray, bool]]:
    """(place, bytes, ends of records) of a file from `at` on, and whether it is the last block.

    No block but the last ends in a carriage return, whose meaning the next byte would decide.
    """
    file.seek(at)
    while at < size:
        data = file.read(STEP_BYTES)
        while data.endswith(b"\r") and at + len(data) < size:
            data += file.read(1)
        values = np.frombuffer(data, np.uint8)
        yield at, data, record_ends(values, inside) + at, at + len(data) >= size
        inside ^= bool(data.count(b'"') % 2)
        at += len(data)


def _header(file) -> list[str]:
    """The names of the columns: the first record."""
    held = b""
    for _, data, ends, last in _blocks(file, 0, False, file.size()):
        held += data
        if len(ends) or last:
            return next(_parsed(held[: int(ends[0])] if len(ends) else held, 0), [])
    return []


def _parsed(data: bytes, place: int) -> Iterator[list[str | None]]:
    """Fields of whole records; an empty field without quotes is None."""
    csv.field_size_limit(sys.maxsize)
    text = data.decode("utf-8-sig" if place == 0 else "utf-8", "replace")
    return csv.reader(io.StringIO(text, newline=""), quoting=csv.QUOTE_NOTNULL)


def _owned(file, start: int, stop: int, inside: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the whole records that begin in [start, stop), some megabytes at a time."""
    size, begin, at, held = file.size(), None if start else 0, 0, b""
    if start:
        # A record begins at `start` if the byte before ends one, so reading begins there.
        file.seek(start - 1)
        inside ^= file.read(1) == b'"'
    for place, data, ends, last in _blocks(file, max(start - 1, 0), inside, size):
        if begin is None:
            ends = ends[ends >= start]
            if not len(ends):
                if place + len(data) >= stop:
                    return
                continue
            begin = int(ends[0])
            if begin >= stop:
                return
            data, place, ends = data[begin - place :], begin, ends[1:]
        if not held:
            at = place
        held += data
        beyond = ends[ends >= stop]
        if len(beyond):
            yield at, held[: int(beyond[0]) - at]
            return
        if last:
            yield at, held
        elif len(held) >= BATCH_BYTES and len(ends):
            cut = int(ends[-1]) - at
            yield at, held[:cut]
            at, held = at + cut, held[cut:]


def _records(file, start: int, chunk_bytes: int, inside: bool, columns: list[str]) -> Iterator[pa.RecordBatch]:
    header = _header(file)
    places = [header.index(c) if c in header else None for c in columns]
    for at, data in _owned(file, start, min(start + chunk_bytes, file.size()), inside):
        rows = (r for r in islice(_parsed(data, at), 1 if at == 0 else 0, None) if r)
        while some := list(islice(rows, BATCH_ROWS)):
            out = [[r[p] if p is not None and p < len(r) else None for r in some] for p in places]
            yield pa.record_batch([pa.array(c, pa.string()) for c in out], names=columns)

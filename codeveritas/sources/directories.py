"""Directory trees as tables: listed in rounds, read and written by executors.

A tree is walked breadth first.  Each round is one job: tasks list the directories of the frontier
and write the entries they find to the shared folder, where the directories of the next round are
read from.  File names therefore never meet on the driver, only those of one directory in a task,
and a lost executor costs the listing of its directories.  Directories that are skipped are not
entered, and files that are skipped are not opened.

Storage is whatever `pyarrow.fs` opens from a URI (local and mounted folders, HDFS, object stores)
and every executor can reach.  Links to directories are not followed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

# Workers get this module by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Schemes that pyarrow opens; a path without a scheme is local or mounted.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs")

#: Bytes of file content in one Arrow batch, and in one task of the reader.
BATCH_BYTES, TASK_BYTES = 16 << 20, 128 << 20

#: Entries in one Arrow batch of a listing.
BATCH_ENTRIES = 10_000

ENTRIES = "path string, is_dir boolean, size bigint, modified timestamp"


def can_open(root: str) -> bool:
    scheme, colon, _ = root.partition(":")
    return not colon or "/" in scheme or scheme in SCHEMES


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root and the root's path on it, without a slash at its end."""
    scheme, colon, rest = root.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        local = root if not colon or "/" in scheme else "/" + rest.lstrip("/")
        return pafs.LocalFileSystem(), local.rstrip("/")
    found, path = pafs.FileSystem.from_uri(root.replace("s3a:", "s3:", 1))
    return found, path.rstrip("/")


def _is_link(store: pafs.FileSystem, path: str) -> bool:
    import os

    return isinstance(store, pafs.LocalFileSystem) and os.path.islink(path)


def _lister(root: str, skipped: frozenset[str], extensions: tuple[str, ...] | None, max_bytes: int | None):
    """Tasks from frontier directories to their entries, all relative to the root."""

    def keep(entry: pafs.FileInfo) -> bool:
        if extensions is not None and not entry.base_name.lower().endswith(extensions):
            return False
        return max_bytes is None or entry.size <= max_bytes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "is_dir", "size", "modified"])

        for batch in batches:
            for directory in batch.column("path").to_pylist():
                at = f"{base}/{directory}" if directory else base or "/"
                for entry in store.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                    path = f"{directory}/{entry.base_name}" if directory else entry.base_name
                    if entry.type == pafs.FileType.Directory:
                        if entry.base_name not in skipped and not _is_link(store, entry.path):
                            rows.append((path, True, None, None))
                    elif entry.type == pafs.FileType.File and keep(entry):
                        rows.append((path, False, entry.size, entry.mtime))
                    if len(rows) >= BATCH_ENTRIES:
                        yield out()
                        rows.clear()
        yield out()

    return task


def list_tree(
    spark: SparkSession, root: str, *, skipped: list[str] | None = None,
    extensions: list[str] | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """path (relative to the root), size, modified of every file below `root` that the filters keep.

    `skipped` are names of directories that are not entered, `extensions` lower-case endings of the
    files kept, `max_bytes` their greatest size.
    """
    task = _lister(root, frozenset(skipped or ()), None if extensions is None else tuple(extensions), max_bytes)
    tasks = 4 * spark.sparkContext.defaultParallelism
    rounds = []
    frontier = spark.createDataFrame([("",)], "path string")
    while True:
        rounds.append(scratch_dir(spark, "listing"))
        frontier.mapInArrow(task, ENTRIES).write.parquet(rounds[-1])
        found = spark.read.schema(ENTRIES).parquet(rounds[-1]).where("is_dir").select("path")
        if not found.limit(1).count():
            break
        # Siblings are listed by different tasks, whichever task found them.
        frontier = found.repartition(tasks, "path")
    return spark.read.schema(ENTRIES).parquet(*rounds).where("not is_dir").select("path", "size", "modified")


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """path, size, content of every listed file; one that cannot be read is empty.

    Files are dealt by a hash of their path into tasks of about TASK_BYTES together.
    """
    total = listing.agg(F.sum("size")).first()[0] or 0
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        paths, contents, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array(paths, pa.string()), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())],
                names=["path", "size", "content"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with store.open_input_file(f"{base}/{path}") as file:
                        content = file.read()
                except OSError:
                    content = b""
                paths.append(path)
                contents.append(content)
                held += len(content)
                if held >= BATCH_BYTES:
                    yield out()
                    paths, contents, held = [], [], 0
        yield out()

    return listing.select("path").repartition(tasks, "path").mapInArrow(task, "path string, size bigint, content binary")


def write_files(files: DataFrame, root: str, path_col: str = "file_path", content_col: str = "content") -> DataFrame:
    """Writes the content of every row to its path below `root`; returns path and size of what was written.

    A task that is run again writes the same files again.  Absolute paths and paths with `..` are refused.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        made: set[str] = set()
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, content in zip(paths, batch.column("content").to_pylist()):
                parts = path.split("/")
                if ".." in parts or parts[0] == "":
                    raise ValueError(f"path leaves its root: {path}")
                directory = f"{base}/{path}".rpartition("/")[0]
                if directory not in made:
                    store.create_dir(directory, recursive=True)
                    made.add(directory)
                with store.open_output_stream(f"{base}/{path}") as file:
                    file.write(content or b"")
            sizes = pa.array([len(c or b"") for c in batch.column("content").to_pylist()], pa.int64())
            yield pa.record_batch([batch.column("path"), sizes], names=["path", "size"])

    rows = files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    written = scratch_dir(files.sparkSession, "written")
    rows.mapInArrow(task, "path string, size bigint").write.parquet(written)
    return files.sparkSession.read.schema("path string, size bigint").parquet(written)

"""Archives as a source: one row per member file."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import sys
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get these functions by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBERS = (
    "scan_id string, archive_path string, file_path string, size_bytes bigint, "
    "content binary, status string"
)

_SINGLE = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}


def _escapes(name: str) -> bool:
    path = PurePosixPath(name)
    return path.is_absolute() or ".." in path.parts


def _members(path: str, data: bytes) -> Iterator[tuple[str, bytes | None]]:
    """(member name, bytes); bytes are None for a blocked name."""
    lower = path.lower()
    if lower.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                if _escapes(info.filename):
                    yield info.filename, None
                elif not info.is_dir():
                    yield info.filename, archive.read(info)
    elif ".tar" in lower or lower.endswith(".tgz"):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
            for info in archive:
                if _escapes(info.name):
                    yield info.name, None
                elif info.isfile():
                    yield info.name, archive.extractfile(info).read()
    else:
        suffix = PurePosixPath(lower).suffix
        with _SINGLE[suffix](io.BytesIO(data), "rb") as stream:
            yield PurePosixPath(path).stem, stream.read()


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["scan_id", "archive_path", "file_path", "size_bytes", "content", "status"]
    for batch in batches:
        for row in batch.itertuples(index=False):
            # One frame per archive keeps at most one unpacked archive in memory.
            out = []
            try:
                for name, body in _members(row.file_path, row.content):
                    size = None if body is None else len(body)
                    status = "blocked" if body is None else "ok"
                    out.append((row.scan_id, row.file_path, name, size, body, status))
            except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, KeyError,
                    lzma.LZMAError, RuntimeError, ValueError):
                out.append((row.scan_id, row.file_path, None, None, None, "unreadable"))
            yield pd.DataFrame(out, columns=columns)


def unpack_archives(archives: DataFrame) -> DataFrame:
    """All members with a status: ``ok``, ``blocked`` (path escape), ``unreadable``."""
    return archives.select("scan_id", "file_path", "content").mapInPandas(_unpack, MEMBERS)


def explode_archives(archives: DataFrame) -> DataFrame:
    """Members as ``files`` rows; blocked and unreadable ones are dropped."""
    return unpack_archives(archives).where(F.col("status") == "ok").select(
        "scan_id", "file_path", "size_bytes", "content"
    )


def blocked_members(archives: DataFrame) -> DataFrame:
    """Dropped members per scan and reason."""
    return (
        unpack_archives(archives)
        .where(F.col("status") != "ok")
        .groupBy("scan_id", "status")
        .agg(F.count("*").alias("members"))
    )

"""What several operators share: reading, row identity, blocks of Arrow rows, writing once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at a time.
BLOCK_BYTES = 500_000

#: A-Z to a-z for bytes.translate; other bytes stay (fixed values).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


NULL_ID = (1 << 63) - 1


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns (id, tie, text), and `carried` if asked for, that name and order every document.

    Where ids are unique and not null, which one aggregate over the id column tells, `tie` is 0.
    Else `tie` is a hash of id and text, so rows that share an id (nulls are one id, after all
    others) are distinct documents in the order of that hash, and rows equal in both are one
    document, with the least of their carried values.  Other columns are left out, so none clashes.
    """
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text, *more)
    twice = rows.groupBy("id").count().filter("count > 1 or id is null").limit(1).count()
    tie = F.xxhash64(F.col("id").isNull(), "id", F.col("text").isNull(), "text") if twice else F.lit(0).cast("long")
    rows = rows.select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), tie.alias("tie"), "text", *(["carried"] if carry else []))
    if not twice:
        return rows
    if carry:
        return rows.groupBy("id", "tie", "text").agg(F.min("carried").alias("carried"))
    return rows.distinct()


def original_id(df: DataFrame) -> DataFrame:
    """Turns the stand-in for a null id back into null."""
    return df.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with about `limit` bytes of text, one row at least, and their texts."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, utf8(piece.column(column))

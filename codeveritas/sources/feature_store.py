"""Features by content hash in an append-only store.

A store is a folder of segments (one row for each distinct content, without the text), each with the
bitmap of its hashes, and a manifest of the segments that count.  A run looks hashes up as narrow rows:
what the bitmaps of the store do not hold is unseen for certain, the rest is joined with the hash column of
the segments.  The hashes found unseen become a bitmap themselves, which decides inside the scan of
the files which texts are computed.  So a text stays in the row it was read in, and no exchange carries it.

Bitmaps have BITS bits whatever they hold.  Where one fills up it lets more through: more hashes are
joined and more texts computed, and the joins on whole hashes decide, so results stay the same.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_and_read

HASH = "content_sha256"

#: Bits of a bitmap, as a power of two (2 MB), and segments that are kept before they become one.
BITS = 24
MOST_SEGMENTS = 16

_BITMAP = "word bigint, bits bigint"


def _place() -> Column:
    return F.shiftrightunsigned(F.xxhash64(HASH), 64 - BITS)


def bitmap_rows(hashes: DataFrame) -> DataFrame:
    """word, bits of the 64-bit words that are not zero."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({HASH}), {64 - BITS}) & 63 as int))")
    return hashes.select(F.shiftright(_place(), 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def may_hold(bitmap: DataFrame) -> Column:
    """Whether a row's hash may be among those of a bitmap; the bitmap becomes a constant of the plan."""
    words = [0] * (1 << (BITS - 6))
    for row in bitmap.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        words[row.word] = row.bits
    if not any(words):
        return F.lit(False)
    held = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    bit = F.expr(f"cast(shiftrightunsigned(xxhash64({HASH}), {64 - BITS}) & 63 as int)")
    return F.getbit(F.get(held, F.shiftright(_place(), 6).cast("int")), bit) == 1


class FeatureStore:
    """Segments below `path`; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[str]:
        """Names of the segments of the newest manifest."""
        try:
            manifest = self.spark.read.schema("version int, segment string").parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return []
        rows = manifest.collect()
        newest = max((r.version for r in rows), default=0)
        return sorted(r.segment for r in rows if r.version == newest and r.segment)

    def _version(self) -> int:
        if not self.segments():
            return 0
        return self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0]

    def _publish(self, segments: list[str]) -> None:
        version = self._version() + 1
        rows = self.spark.createDataFrame([(version, s) for s in segments], "version int, segment string")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def rows(self, *columns: str) -> DataFrame | None:
        """All stored rows, or None for an empty store."""
        names = self.segments()
        if not names:
            return None
        # Segments share their columns, so one of them tells the schema of all.
        schema = self.spark.read.parquet(f"{self.path}/segments/{names[0]}").schema
        read = self.spark.read.schema(schema).parquet(*[f"{self.path}/segments/{s}" for s in names])
        return read.select(*columns) if columns else read

    def bitmap(self) -> DataFrame:
        return self.spark.read.schema(_BITMAP).parquet(*[f"{self.path}/bitmaps/{s}" for s in self.segments()])

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        rows.write.parquet(at)
        # A bitmap is one small file, so that opening a store lists few.
        bitmap_rows(self.spark.read.parquet(at)).coalesce(1).write.parquet(f"{self.path}/bitmaps/{name}")
        return name

    def append(self, rows: DataFrame) -> None:
        """Adds rows of unseen hashes as a segment; many segments become one."""
        names = [*self.segments(), self._write(rows)]
        self._publish(names)
        if len(names) > MOST_SEGMENTS:
            self._publish([self._write(self.rows())])

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Those of distinct `hashes` that no segment holds."""
        stored = self.rows(HASH)
        if stored is None:
            return hashes
        known = may_hold(self.bitmap())
        return hashes.where(~known).unionByName(hashes.where(known).join(stored, HASH, "left_anti"))


def feature_cache(files: DataFrame, path: str, compute) -> DataFrame:
    """Features of all distinct contents of `files` (content_sha256, code), computing only unseen ones.

    ``compute`` maps a frame (content_sha256, code) to one row for each of its rows, row by row.  Copies of
    an unseen content are computed where each was read and one result is kept.
    """
    spark = files.sparkSession
    store = FeatureStore(spark, path)
    wanted = files.select(HASH).where(F.col(HASH).isNotNull()).distinct()
    # Read three times, and the store is about to change below it.
    fresh = write_and_read(store.unseen(wanted), "unseen")
    if fresh.limit(1).count():
        texts = files.select(HASH, "code").where(may_hold(bitmap_rows(fresh)))
        made = compute(texts)
        rest = [c for c in made.columns if c != HASH]
        one = made.groupBy(HASH).agg(F.first(F.struct(*rest)).alias("_f")).select(HASH, *[F.col(f"_f.{c}").alias(c) for c in rest])
        store.append(one.join(fresh, HASH, "left_semi"))
    stored = store.rows()
    if stored is None:
        # Nothing was ever asked for: the columns of no rows.
        return compute(files.select(HASH, "code").limit(0))
    return stored.join(wanted, HASH, "left_semi")

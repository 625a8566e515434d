"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    # Records the Python line of every column; costs seconds on large expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: Removes the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "codeveritas", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names that folder.  Only a local session that names none gets
    a temporary one, removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="codeveritas-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    _MADE.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


#: Scratch folders of this process that have not been dropped, oldest first.
_MADE: list[str] = []


def scratch_made() -> list[str]:
    """The scratch folders made so far and not dropped."""
    return list(_MADE)


def drop_scratch(spark: SparkSession, paths: list[str], *still_read: DataFrame) -> None:
    """Removes scratch folders, but those that the frames `still_read` read from.

    For use between steps whose results have been written: other frames over these folders can no
    longer be read.
    """
    wanted = [file for df in still_read for file in df.inputFiles()]
    for path in paths:
        if path not in _MADE or any(path.rpartition("/")[2] in file for file in wanted):
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.remove(path)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Store an intermediate table once and read it back.

    Used where several branches need the same expensive projection: the text
    is then read and scanned once, and a lost executor only costs a re-read.
    Its shuffle files go when it has been written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that has fewer input splits than the cluster has cores.

    A large table has far more splits than cores and passes through untouched;
    a single small file would otherwise be scanned by one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def hot_key_parts(df: DataFrame) -> int:
    """Parts that the rows of one key are dealt into: two for every core, so they grow with the cluster."""
    return max(16, 2 * df.sparkSession.sparkContext.defaultParallelism)


def row_parts(df: DataFrame) -> int:
    """Parts for short rows that compress well, which a sort or hash table holds unpacked.

    Adaptive execution sizes parts by compressed bytes and down to one for each core, so those of a
    large table outgrow a task.
    """
    return max(200, 16 * df.sparkSession.sparkContext.defaultParallelism)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame | None:
    """The frame marked for broadcast, or None when it has more rows.

    Counting stops one row past the limit.  For narrow tables only.
    """
    from pyspark.sql import functions as F

    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else None

"""Scan life cycle from an append-only event table.

``scan_events``: scan_id, ts, status, error.  One scan may own a third of all
events, so nothing here sorts a whole scan in one task: order is settled
inside time slices, and the slices' summaries are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ranking import ordered_buckets

# 300 polls of 2 s, and errors in a row that end polling.
STALL_SECONDS = 600
ERROR_RUN = 5


def progress_of(status: Column) -> Column:
    """Progress of a stage in percent; null for failed or unknown stages."""
    pairs = [F.lit(x) for item in schemas.STAGE_PROGRESS.items() for x in item]
    return F.element_at(F.create_map(*pairs), status)


def latest_status(events: DataFrame) -> DataFrame:
    """Current stage, progress and error per scan.

    A maximum combines map-side, so a busy scan costs one row per task.  Works
    on a batch and, in update mode, on a stream.
    """
    latest = F.max(F.struct("ts", "event_id", "status", "error")).alias("e")
    return events.groupBy("scan_id").agg(latest, F.count("*").alias("events")).select(
        "scan_id",
        F.col("e.ts").alias("updated_at"),
        F.col("e.status").alias("status"),
        progress_of(F.col("e.status")).alias("progress"),
        F.col("e.error").alias("error"),
        "events",
    )


def _sliced(events: DataFrame, slices: int | None) -> DataFrame:
    # Slices hold equal shares of all events, so a burst is cut up as well.
    return ordered_buckets(events, F.unix_micros("ts"), "_slice", slices)


def stage_durations(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Seconds until the scan's next event, for every event that has one.

    Inside a slice the next event is a ``lead``; the last event of a slice
    takes the first timestamp of the scan's next slice.
    """
    sliced = _sliced(events, slices)
    in_slice = W.partitionBy("scan_id", "_slice").orderBy("ts", "event_id")
    first_of_next = F.lead("_first").over(W.partitionBy("scan_id").orderBy("_slice"))
    starts = (
        sliced.groupBy("scan_id", "_slice").agg(F.min("ts").alias("_first"))
        .select("scan_id", "_slice", first_of_next.alias("_next_slice"))
    )
    ends = sliced.withColumn("_next", F.lead("ts").over(in_slice)).join(
        starts, ["scan_id", "_slice"]
    )
    following = F.coalesce("_next", "_next_slice")
    seconds = (F.unix_micros(following) - F.unix_micros("ts")) / 1e6
    return (
        ends.withColumn("seconds", seconds)
        .where(F.col("seconds").isNotNull())
        .select("scan_id", "event_id", "status", progress_of(F.col("status")).alias("progress"),
                "seconds")
    )


def longest_error_runs(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Longest run of consecutive failures per scan.

    A slice is summarised by its size and its leading, trailing and longest
    run; the scan's summaries, at most one per slice, are then folded in time
    order.
    """
    sliced = _sliced(events, slices).withColumn(
        "_bad", (F.col("status") == "failed").cast("int")
    )
    order = W.partitionBy("scan_id", "_slice").orderBy("ts", "event_id")
    numbered = sliced.select(
        "scan_id", "_slice", "_bad", F.row_number().over(order).alias("_i"),
        F.sum(1 - F.col("_bad")).over(order).alias("_run"),
    )
    # Failures that share the number of successes before them form one run;
    # run 0 is the leading one.
    runs = numbered.groupBy("scan_id", "_slice", "_run").agg(F.sum("_bad").alias("_len"))
    size = F.sum("_len") + F.max("_run")
    summary = runs.groupBy("scan_id", "_slice").agg(
        size.alias("n"),
        F.sum(F.when(F.col("_run") == 0, F.col("_len")).otherwise(0)).alias("head"),
        F.max_by("_len", "_run").alias("tail"),
        F.max("_len").alias("best"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_slice", "n", "head", "tail", "best")))
    zero = F.lit(0).cast("bigint")

    def fold(acc: Column, s: Column) -> Column:
        joined = acc["open"] + s["head"]
        whole = s["head"] == s["n"]
        return F.struct(
            F.when(whole, joined).otherwise(s["tail"]).alias("open"),
            F.greatest(acc["best"], s["best"], joined).alias("best"),
        )

    folded = F.aggregate(ordered, F.struct(zero.alias("open"), zero.alias("best")), fold)
    return summary.groupBy("scan_id").agg(folded["best"].alias("error_run"))


def stalled_scans(events: DataFrame, now, timeout_s: int = STALL_SECONDS) -> DataFrame:
    """Scans that never finished in time, or failed too often in a row."""
    latest = latest_status(events)
    idle = F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(timeout_s))
    timed_out = (F.col("updated_at") < idle) & ~F.col("status").isin(schemas.TERMINAL_STAGES)
    runs = longest_error_runs(events)
    return (
        latest.join(runs, "scan_id")
        .withColumn("timed_out", timed_out)
        .withColumn("too_many_errors", F.col("error_run") >= ERROR_RUN)
        .where("timed_out or too_many_errors")
        .select("scan_id", "status", "timed_out", "too_many_errors", "error_run")
    )


def finding_rate(events: DataFrame, by: str, window: str = "1 day") -> DataFrame:
    """Rows per tumbling window and ``by``; batch or stream."""
    return events.groupBy(F.window("ts", window).alias("w"), by).agg(
        F.count("*").alias("n")
    ).select(F.unix_seconds("w.start").alias("window_start"), by, "n")

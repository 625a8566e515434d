"""Structured Streaming jobs over files, findings and scan events."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from .. import schemas
from ..operators import lifecycle
from ..operators.symbols import KEY

# Workers get the processors by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Timestamps inside a stored report keep their microseconds and zone.
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """State on local disk with checkpointed snapshots, as timers and TTL need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def no_idle_batches(spark: SparkSession) -> Iterator[None]:
    """Queries started inside run batches only when there is input.

    Processing-time state asks for one more batch forever, so a run over the
    available input would not end.  Expired state is then dropped by the next
    batch that has input.
    """
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table_stream(
    spark: SparkSession, folder: str, schema: StructType, file_name: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files of a folder, or of its table ``file_name``, a file or a folder, as a stream, each read once."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A pattern, as a stream takes no plain path of a single file; a name filter
    # would look at the part files of a table that is a folder.
    return reader.parquet(f"{folder}/{{{file_name}}}" if file_name else folder)


def run_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str,
    checkpoint: str, mode: str = "append",
) -> StreamingQuery:
    """Applies a batch function to every micro-batch.

    A batch writes its own folder and overwrites it when it is replayed, so a
    restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def stream_to_table(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a parquet folder, each row once."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", output)
        .trigger(availableNow=True)
        .start()
    )


def stream_files(
    files: DataFrame, scan: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Scans each arriving file once; ``scan`` is a per-file batch function."""
    return run_batches(files, scan, output, checkpoint)


def stream_latest_status(events: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Changed scans per micro-batch with their current stage; finished scans leave the state."""
    return run_batches(live_status(events), lambda batch: batch, output, checkpoint, "update")


def stream_finding_rate(
    events: DataFrame, by: str, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Counts per closed tumbling window; rows later than ``delay`` are dropped."""
    return lifecycle.finding_rate(events.withWatermark("ts", delay), by, window)


def stream_dedup_findings(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival per (scan, file, line, rule) within the watermark delay."""
    return findings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        [*KEY, "line_start", "rule_id"]
    )


class _ScanWatch(StatefulProcessor):
    """Follows a scan in event order and emits it when it stalls or fails too often in a row.

    Events come in any order: they wait in a list until the watermark has
    passed them, and are then folded, oldest first, into the run of failures
    that is open.  A run is reported once, when it reaches its length; a stall
    wherever the next event, or the watermark without one, is beyond the timeout.
    """

    def __init__(self, timeout_ms: int, error_run: int, terminal: list[str]) -> None:
        self.timeout_ms = timeout_ms
        self.error_run = error_run
        self.terminal = terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        event = "ts_us bigint, event_id bigint, status string"
        self.waiting = handle.getListState("waiting", event)
        self.last = handle.getValueState("last", f"{event}, failures int, stalled boolean")

    def _state(self) -> tuple:
        return self.last.get() if self.last.exists() else (None, None, None, 0, False)

    def _set_timer(self, waiting: list[tuple], state: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(min(e[0] for e in waiting) // 1000)
        elif state[0] is not None and state[2] not in self.terminal and not state[4]:
            self.handle.registerTimer(state[0] // 1000 + self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = [
            (int(t), int(e), str(s)) for frame in rows
            for t, e, s in zip(frame.ts_us, frame.event_id, frame.status, strict=True)
        ]
        self.waiting.appendList(arrived)
        self._set_timer(list(self.waiting.get()), self._state())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed_ms = timerValues.getCurrentWatermarkInMs()
        everything = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in everything if e[0] // 1000 <= passed_ms]
        later = everything[len(due) :]
        ts, event_id, status, failures, stalled = self._state()
        out = []

        def idle_until(until_ms: int) -> bool:
            open_ = ts is not None and not stalled and status not in self.terminal
            return open_ and ts // 1000 + self.timeout_ms < until_ms

        for event in due:
            if idle_until(event[0] // 1000):
                out.append((key[0], status, ts // 1000, "timeout"))
            ts, event_id, status = event
            stalled = False
            failures = failures + 1 if status == "failed" else 0
            if failures == self.error_run:
                out.append((key[0], status, ts // 1000, "errors"))
        # Up to the watermark nothing else can come; what waits comes after it.
        if idle_until(min(passed_ms + 1, later[0][0] // 1000) if later else passed_ms + 1):
            stalled = True
            out.append((key[0], status, ts // 1000, "timeout"))
        state = (ts, event_id, status, failures, stalled)
        if ts is not None:
            self.last.update(state)
        self.waiting.put(later) if later else self.waiting.clear()
        self._set_timer(later, state)
        if out:
            yield pd.DataFrame(out, columns=["scan_id", "status", "last_ts_ms", "reason"])

    def close(self) -> None:
        pass


def stream_stalled_scans(
    events: DataFrame, timeout_s: int = lifecycle.STALL_SECONDS, delay: str = "1 minute",
    error_run: int = lifecycle.ERROR_RUN,
) -> DataFrame:
    """Scans that stall or fail ``error_run`` times in a row, by event time.

    A replay, other batches or a restart give the same rows, as long as no
    event comes later than ``delay``.  A run of failures is reported where it
    reaches its length, again for every new run.
    """
    timed = events.withWatermark("ts", delay).select(
        "scan_id", "status", "ts", F.unix_micros("ts").alias("ts_us"),
        F.col("event_id").cast("bigint").alias("event_id"),
    )
    return timed.groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_ScanWatch(timeout_s * 1000, error_run, schemas.TERMINAL_STAGES),
        outputStructType="scan_id string, status string, last_ts_ms bigint, reason string",
        outputMode="Append",
        timeMode="EventTime",
    )


class _LiveStatus(StatefulProcessor):
    """The newest event of a scan, until the watermark passes a terminal one by ``keep_ms``."""

    def __init__(self, keep_ms: int, terminal: list[str]) -> None:
        self.keep_ms = keep_ms
        self.terminal = terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState(
            "newest", "ts_us bigint, event_id bigint, status string, error string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = tuple(self.newest.get()) if self.newest.exists() else None
        before = newest
        for frame in rows:
            row = frame.sort_values(["ts_us", "event_id"]).iloc[-1]
            error = None if pd.isna(row.error) else str(row.error)
            seen = (int(row.ts_us), int(row.event_id), str(row.status), error)
            newest = seen if newest is None or seen[:2] > newest[:2] else newest
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.newest.update(newest)
        if newest[2] in self.terminal:
            self.handle.registerTimer(newest[0] // 1000 + self.keep_ms)
        if newest != before:
            yield pd.DataFrame(
                [(key[0], *newest)], columns=["scan_id", "ts_us", "event_id", "status", "error"]
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_status(events: DataFrame, keep_s: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Changes of the current stage of scans; finished scans leave the state.

    A scan is forgotten ``keep_s`` after its terminal event.  Events later than
    ``delay`` are dropped, so none can bring back an older stage.
    """
    timed = events.withWatermark("ts", delay).select(
        "scan_id", "ts", F.unix_micros("ts").alias("ts_us"),
        F.col("event_id").cast("bigint").alias("event_id"), "status", "error",
    )
    changes = timed.groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_LiveStatus(keep_s * 1000, schemas.TERMINAL_STAGES),
        outputStructType="scan_id string, ts_us bigint, event_id bigint, status string, error string",
        outputMode="Update",
        timeMode="EventTime",
    )
    return changes.select(
        "scan_id", F.timestamp_micros("ts_us").alias("updated_at"), "event_id", "status",
        lifecycle.progress_of(F.col("status")).alias("progress"), "error",
    )


class _ReportStore(StatefulProcessor):
    """Keeps the newest report of a scan, whole, until its time to live is over."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.report = handle.getValueState(
            "report", "generated_us bigint, report string", self.ttl_ms
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = tuple(self.report.get()) if self.report.exists() else None
        for frame in rows:
            # Of reports of one instant the last in the order of its text counts.
            row = frame.sort_values(["generated_us", "report"]).iloc[-1]
            seen = (int(row.generated_us), str(row.report))
            kept = seen if kept is None or seen >= kept else kept
        self.report.update(kept)
        yield pd.DataFrame([(key[0], kept[1])], columns=["scan_id", "report"])

    def close(self) -> None:
        pass


def report_store(reports: DataFrame, ttl_s: int = schemas.REPORT_TTL_SECONDS) -> DataFrame:
    """Newest live report per scan with all its columns; state expires ``ttl_s`` after its last update.

    A report travels and is kept as one JSON document; ``scan_id`` and
    ``generated_at`` are required, all other columns are the caller's.
    """
    body = [c for c in reports.columns if c != "scan_id"]
    schema = reports.select(*body).schema
    whole = reports.select(
        "scan_id", F.unix_micros("generated_at").alias("generated_us"),
        F.to_json(F.struct(*body), {"timestampFormat": _STAMP, "ignoreNullFields": "false"}).alias("report"),
    )
    kept = whole.groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_ReportStore(ttl_s * 1000),
        outputStructType="scan_id string, report string",
        outputMode="Update",
        timeMode="ProcessingTime",
    )
    parsed = F.from_json("report", schema, {"timestampFormat": _STAMP})
    return kept.select("scan_id", parsed.alias("r")).select("scan_id", "r.*")

"""Stateful streams over several micro-batches, in any order of events, and across a restart."""

from __future__ import annotations

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from codeveritas.operators import lifecycle
from codeveritas.streaming import jobs

EVENTS = "scan_id string, event_id long, ts timestamp, status string, error string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def history(seed):
    """Events of eight scans in order of time; the last event moves the watermark past all others."""
    draw = random.Random(seed)
    rows, clock = [], 0.0
    for k in range(260):
        clock += draw.choice([1, 5, 20, 90])
        status = draw.choice(["queued", "cloning", "failed", "failed", "failed", "completed"])
        rows.append((f"s{draw.randrange(8)}", k, at(clock), status, f"e{k}" if status == "failed" else None))
    return [*rows, ("end", 1000, at(clock + 5000), "completed", None)], clock


def expected(rows, timeout, run):
    """Stalls and runs of failures of events read in order."""
    out, of = [], {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        of.setdefault(row[0], []).append(row)
    end = max(r[2] for r in rows) - dt.timedelta(minutes=5)
    for scan, events in of.items():
        if scan == "end":
            continue
        failures = 0
        for k, (_, _, ts, status, _) in enumerate(events):
            failures = failures + 1 if status == "failed" else 0
            if failures == run:
                out.append((scan, status, ts, "errors"))
            until = events[k + 1][2] if k + 1 < len(events) else end
            if status not in ("completed", "failed") and ts + dt.timedelta(seconds=timeout) < until:
                out.append((scan, status, ts, "timeout"))
    return sorted((s, st, int(ts.timestamp() * 1000), why) for s, st, ts, why in out)


def feed(spark, folder, rows, sizes, draw):
    """Writes rows as files that the source takes in order of their times; returns their number.

    Within a file order is random, and files overlap by up to two minutes.
    """
    (folder / "in").mkdir(parents=True, exist_ok=True)
    keyed = sorted(rows, key=lambda r: r[2].timestamp() + draw.uniform(0, 120))
    done, files = 0, 0
    while done < len(keyed):
        part = keyed[done : done + draw.choice(sizes)]
        done, files = done + len(part), files + 1
        draw.shuffle(part)
        made = folder / f"made-{uuid.uuid4().hex}"
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(made))
        k = len(list((folder / "in").iterdir()))
        target = folder / "in" / f"{k:04d}.parquet"
        target.write_bytes(next(made.glob("part-*.parquet")).read_bytes())
        os.utime(target, (1_700_000_000 + k,) * 2)
    return files


def source(spark, folder):
    schema = spark.createDataFrame([], EVENTS).schema
    return jobs.read_table_stream(spark, str(folder / "in"), schema, max_files=1)


@pytest.fixture()
def rocksdb(spark):
    jobs.use_rocksdb_state(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stalls_and_failures_across_batches_and_a_restart(spark, rocksdb, tmp_path):
    rows, clock = history(3)
    half = [r for r in rows if r[2] < at(clock / 2)]
    rest = [r for r in rows if r[2] >= at(clock / 2)]
    draw = random.Random(1)
    want = expected(rows, 120, 3)
    assert {w[3] for w in want} == {"errors", "timeout"} and len(want) > 20
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    batches = 0
    for part in (half, rest):
        batches += feed(spark, tmp_path / "files", part, [90, 120], draw)
        stalled = jobs.stream_stalled_scans(source(spark, tmp_path / "files"), 120, "5 minutes", 3)
        jobs.stream_to_table(stalled, out, checkpoint).awaitTermination()
    assert batches >= 3
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("scan_id", "status", "last_ts_ms", "reason").collect())
    assert got == want


def test_live_status_forgets_finished_scans(spark, rocksdb, tmp_path):
    rows = [("a", 1, at(0), "queued", None), ("b", 2, at(1), "cloning", None), ("a", 3, at(60), "completed", None)]
    draw = random.Random(2)
    feed(spark, tmp_path / "files", rows, [3], draw)
    feed(spark, tmp_path / "files", [("c", 4, at(9000), "queued", None)], [1], draw)
    feed(spark, tmp_path / "files", [("b", 5, at(9001), "failed", "why"), ("c", 6, at(8990), "cloning", None)], [2], draw)
    live = jobs.live_status(source(spark, tmp_path / "files"), keep_s=60, delay="1 minute")
    query = jobs.run_batches(live, lambda b: b, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "update")
    query.awaitTermination()
    last = {r.scan_id: (r.status, r.progress, r.error) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()}
    assert last == {"a": ("completed", 100.0, None), "b": ("failed", None, "why"), "c": ("queued", 0.0, None)}
    state = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "newest").load()
    assert {r.key.scan_id for r in state.collect()} == {"b", "c"}


def test_whole_reports_come_back(spark, rocksdb, tmp_path):
    schema = "scan_id string, generated_at timestamp, trust_score double, detail struct<files: array<string>, n: bigint>, note string"
    def write(k, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(str(tmp_path / f"tmp{k}"))
        (made,) = (tmp_path / f"tmp{k}").glob("part-*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.parquet").write_bytes(made.read_bytes())

    def run(ttl):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with jobs.no_idle_batches(spark):
            jobs.run_batches(jobs.report_store(stream, ttl), lambda b: b, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "update").awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    write(1, ("a", at(0.000001), 1.5, (["x", "é"], 2), None), ("b", at(5), None, None, "n"))
    write(2, ("a", at(9), 2.5, (["y"], 3), "new"), ("a", at(3), 0.0, None, "old"))
    rows = {(r.scan_id, r.batch): r for r in run(3600).collect()}
    assert rows["a", 1].trust_score == 2.5 and rows["a", 1].detail.files == ["y"] and rows["a", 1].note == "new"
    first = rows["a", 0]
    assert (first.generated_at.microsecond, list(first.detail.files), first.detail.n, first.note) == (1, ["x", "é"], 2, None)
    assert (rows["b", 0].trust_score, rows["b", 0].detail, rows["b", 0].note) == (None, None, "n")


def test_batch_and_stream_agree_on_the_latest_stage(spark, rocksdb, tmp_path):
    rows, _ = history(5)
    assert feed(spark, tmp_path / "files", rows, [60, 110], random.Random(4)) >= 3
    live = jobs.live_status(source(spark, tmp_path / "files"), keep_s=100_000, delay="10 minutes")
    jobs.run_batches(live, lambda b: b, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "update").awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out"))
    newest = changes.groupBy("scan_id").agg(F.max_by(F.struct("updated_at", "status", "progress", "error"), "batch").alias("s")).select("scan_id", "s.*")
    batch = lifecycle.latest_status(spark.createDataFrame(rows, EVENTS)).select("scan_id", "updated_at", "status", "progress", "error")
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, batch.collect()))


def test_findings_that_arrive_again_in_later_batches_are_dropped(spark, rocksdb, tmp_path):
    schema = "scan_id string, file_path string, line_start int, rule_id string, severity string, ts timestamp"
    batches = [
        [("a", "f", 1, "r", "low", at(0)), ("a", "f", 2, "r", "low", at(1)), ("a", "f", 1, "r", "low", at(2))],
        [("a", "f", 1, "r", "low", at(10)), ("b", "f", 1, "r", "low", at(11)), ("a", "f", 1, "s", "low", at(12))],
        [("a", "f", 2, "r", "low", at(20)), ("a", "g", 1, "r", "low", at(21))],
    ]
    (tmp_path / "in").mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        (tmp_path / "in" / f"{k}.parquet").write_bytes(next((tmp_path / f"made{k}").glob("part-*.parquet")).read_bytes())
        # Every batch is a run of its own, so the state also outlives restarts.
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_to_table(jobs.stream_dedup_findings(stream), out, checkpoint).awaitTermination()
    got = spark.read.parquet(out).select("scan_id", "file_path", "line_start", "rule_id").collect()
    assert sorted(tuple(r) for r in got) == [
        ("a", "f", 1, "r"), ("a", "f", 1, "s"), ("a", "f", 2, "r"), ("a", "g", 1, "r"), ("b", "f", 1, "r")]


@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_is_streamed_whole_as_a_file_and_as_a_folder(spark, tmp_path, parts):
    made, table = tmp_path / "made", tmp_path / "sf" / "events.parquet"
    spark.range(100).repartition(parts or 1).write.parquet(str(made))
    spark.range(7).write.parquet(str(tmp_path / "sf" / "other.parquet"))
    if parts:
        spark.read.parquet(str(made)).write.parquet(str(table))
    else:
        table.write_bytes(next(made.glob("part-*.parquet")).read_bytes())
    stream = jobs.read_table_stream(spark, str(tmp_path / "sf"), spark.range(1).schema, "events.parquet")
    out = str(tmp_path / "out")
    jobs.stream_to_table(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(100))

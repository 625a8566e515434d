"""Registered queries: scan life cycle and Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, rules
from ..operators.symbols import KEY
from ..session import scratch_dir
from ..streaming import jobs
from . import oracle as o
from . import views
from .catalog import query
from .oracle import with_
from .queries_corpus import long
from .trust_report import file_facts

_NOW = "2024-02-01 00:00:00"
_LAST = (
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, "
    "event_id DESC) AS rn, count(*) OVER (PARTITION BY scan_id) AS events FROM scan_events), "
    "latest AS (SELECT * FROM numbered WHERE rn = 1)"
)
_PROGRESS = (
    "CASE status WHEN 'queued' THEN 0.0 WHEN 'cloning' THEN 10.0 WHEN 'authorship' THEN 40.0 "
    "WHEN 'completed' THEN 100.0 END::DOUBLE"
)
_LATEST_SQL = with_(o.EVENTS, _LAST) + (
    f" SELECT scan_id, epoch_us(ts) AS updated_us, status, {_PROGRESS} AS progress, error "
    "FROM latest"
)


def _latest_columns(df):
    return df.select(
        "scan_id", F.unix_micros("updated_at").alias("updated_us"), "status", "progress", "error"
    )


@query("latest_status", _LATEST_SQL)
def _(spark, sf):
    return _latest_columns(lifecycle.latest_status(views.scan_events(spark, sf)))


@query("stage_durations", with_(o.EVENTS) + " SELECT scan_id, event_id, status, "
       f"{_PROGRESS} AS progress, round(seconds, 6) AS seconds FROM (SELECT *, (epoch_us(lead(ts) "
       "OVER (PARTITION BY scan_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0 "
       "AS seconds FROM scan_events) WHERE seconds IS NOT NULL")
def _(spark, sf):
    rows = lifecycle.stage_durations(views.scan_events(spark, sf))
    return rows.withColumn("seconds", F.round("seconds", 6))


_RUNS = (
    "marked AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY "
    "scan_id ORDER BY ts, event_id) AS grp FROM scan_events), "
    "runs AS (SELECT scan_id, max(n) AS error_run FROM (SELECT scan_id, grp, count(*) FILTER "
    "(WHERE status = 'failed') AS n FROM marked GROUP BY 1, 2) GROUP BY 1)"
)


@query("longest_error_runs", with_(o.EVENTS, _RUNS) + " SELECT scan_id, error_run FROM runs")
def _(spark, sf):
    return lifecycle.longest_error_runs(views.scan_events(spark, sf))


@query("stalled_scans", with_(o.EVENTS, _LAST, _RUNS) + " SELECT * FROM (SELECT scan_id, status, "
       f"ts < TIMESTAMP '{_NOW}' - INTERVAL 600 SECOND AND status NOT IN ('completed', 'failed') "
       "AS timed_out, error_run >= 5 AS too_many_errors, error_run FROM latest JOIN runs "
       "USING (scan_id)) WHERE timed_out OR too_many_errors")
def _(spark, sf):
    return lifecycle.stalled_scans(views.scan_events(spark, sf), f"{_NOW}Z")


@query("finding_rate", with_(o.EVENTS) + " SELECT epoch(date_trunc('day', ts))::BIGINT "
       "AS window_start, status, count(*) AS n FROM scan_events GROUP BY 1, 2")
def _(spark, sf):
    return lifecycle.finding_rate(views.scan_events(spark, sf), "status")


# ---------------------------------------------------------------------------
# Streams, run until all available input is processed
# ---------------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    events = jobs.read_table_stream(spark, sf, schema, "events.parquet")
    return views.with_utc_time(views._select(events, views.EVENT_COLUMNS))


def _run(spark, start, name):
    output, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-checkpoint")
    start(output, checkpoint).awaitTermination()
    return spark.read.parquet(output)


@query("stream_latest_status", _LATEST_SQL)
def _(spark, sf):
    jobs.use_rocksdb_state(spark)
    changes = _run(
        spark, lambda out, cp: jobs.stream_latest_status(_event_stream(spark, sf), out, cp),
        "latest",
    )
    newest = F.max_by(F.struct("updated_at", "status", "progress", "error"), "batch").alias("s")
    return _latest_columns(changes.groupBy("scan_id").agg(newest).select("scan_id", "s.*"))


# The stream's watermark is one hour behind the newest event; only windows that
# ended by then are emitted.
@query("stream_finding_rate", with_(o.EVENTS) + " SELECT epoch(date_trunc('day', ts))::BIGINT "
       "AS window_start, status, count(*) AS n FROM scan_events GROUP BY 1, 2 HAVING "
       "date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM scan_events) "
       "- INTERVAL 1 HOUR")
def _(spark, sf):
    rates = jobs.stream_finding_rate(_event_stream(spark, sf), "status")
    return _run(spark, lambda out, cp: jobs.stream_to_table(rates, out, cp), "rate")


# A scan stalls wherever the next event is more than the timeout away, and
# fails too often wherever a run of failures reaches five; both once the watermark has passed.
_STALLS = (
    "passed AS (SELECT epoch_us(max(ts)) // 1000 - 60000 AS wm FROM scan_events), "
    "ordered AS (SELECT scan_id, status, epoch_us(ts) // 1000 AS ms, sum(CASE WHEN status <> 'failed' "
    "THEN 1 ELSE 0 END) OVER w AS grp, lead(epoch_us(ts) // 1000) OVER w AS next_ms, ts, event_id "
    "FROM scan_events WINDOW w AS (PARTITION BY scan_id ORDER BY ts, event_id)), "
    "failures AS (SELECT *, row_number() OVER (PARTITION BY scan_id, grp ORDER BY ts, event_id) AS k "
    "FROM ordered WHERE status = 'failed')"
)


@query("stream_stalled_scans", with_(o.EVENTS, _STALLS) + " SELECT scan_id, status, ms AS last_ts_ms, "
       "'timeout' AS reason FROM ordered, passed WHERE status NOT IN ('completed', 'failed') AND "
       "ms + 600000 <= wm AND (next_ms IS NULL OR next_ms > ms + 600000) UNION ALL "
       "SELECT scan_id, status, ms, 'errors' FROM failures, passed WHERE k = 5 AND ms <= wm")
def _(spark, sf):
    jobs.use_rocksdb_state(spark)
    stalled = jobs.stream_stalled_scans(_event_stream(spark, sf))
    return _run(spark, lambda out, cp: jobs.stream_to_table(stalled, out, cp), "stalled")


@query("stream_report_store", with_(o.EVENTS, _LAST) + " SELECT scan_id, epoch_us(ts) AS generated_us, "
       "event_id, status, error, (event_id % 100)::DOUBLE AS trust_score, "
       "length(status)::BIGINT AS size FROM latest")
def _(spark, sf):
    # Every event is a report with a nested column; the store returns the last of each scan, whole.
    jobs.use_rocksdb_state(spark)
    made = _event_stream(spark, sf).select(
        "scan_id", F.col("ts").alias("generated_at"), "event_id", "status", "error",
        (F.col("event_id") % 100).cast("double").alias("trust_score"),
        F.struct(F.length("status").cast("bigint").alias("size")).alias("detail"),
    )
    store = jobs.report_store(made)
    with jobs.no_idle_batches(spark):
        rows = _run(
            spark, lambda out, cp: jobs.run_batches(store, lambda b: b, out, cp, "update"), "store"
        )
    return rows.select(
        "scan_id", F.unix_micros("generated_at").alias("generated_us"), "event_id", "status", "error",
        "trust_score", "detail.size",
    )


def _document_stream(spark, sf, columns):
    schema = views.table(spark, sf, "documents").schema
    documents = jobs.read_table_stream(spark, sf, schema, "documents.parquet")
    return views._as_files(views._select(documents, columns))


@query("stream_dedup_findings", with_(*o.CODE, o.LINES, o.FINDINGS) + " SELECT scan_id, file_path, "
       "line_start, rule_id FROM findings")
def _(spark, sf):
    from ..sources.files import prepare

    code = prepare(_document_stream(spark, sf, views.CODE_COLUMNS))
    found = rules.scan_rules(code)
    # Every finding arrives twice.
    twice = found.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")
    )
    unique = jobs.stream_dedup_findings(twice)
    rows = _run(spark, lambda out, cp: jobs.stream_to_table(unique, out, cp), "dedup")
    return rows.select(*KEY, long("line_start"), "rule_id")


@query("stream_files", with_(*o.CODE, o.LINES) + " SELECT f.scan_id, f.file_path, f.language, "
       "count(*) AS line_count FROM files f JOIN lines USING (doc_id) GROUP BY 1, 2, 3")
def _(spark, sf):
    from ..sources.files import prepare

    arriving = _document_stream(spark, sf, views.CODE_COLUMNS)
    facts = _run(
        spark,
        lambda out, cp: jobs.stream_files(
            arriving, lambda batch: file_facts(prepare(batch), bits=views.BITS), out, cp
        ),
        "stream-facts",
    )
    return facts.select(*KEY, "language", "line_count")

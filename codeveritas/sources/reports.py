"""Report and metric stores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def write_reports(reports: DataFrame, path: str) -> None:
    """One row per scan, partitioned by UTC day so a lookup reads one folder."""
    utc_day = F.to_date(F.to_utc_timestamp("generated_at", F.current_timezone()))
    (
        reports.withColumn("generated_date", utc_day)
        .write.mode("append")
        .partitionBy("generated_date")
        .parquet(path)
    )


def lookup_report(
    spark: SparkSession, path: str, scan_id: str, generated_date: dt.date | None = None
) -> DataFrame:
    """The report of one scan; the date, if known, prunes partitions."""
    reports = spark.read.parquet(path)
    if generated_date is not None:
        reports = reports.where(F.col("generated_date") == F.lit(generated_date))
    return reports.where(F.col("scan_id") == scan_id)


def expire_reports(
    reports: DataFrame, now, ttl_s: int = schemas.REPORT_TTL_SECONDS
) -> DataFrame:
    """Reports younger than the time to live."""
    oldest = F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(ttl_s))
    return reports.where(F.col("generated_at").cast("timestamp") > oldest)


def reports_as_json(reports: DataFrame) -> DataFrame:
    """scan_id and the whole report row as one JSON document."""
    return reports.select("scan_id", F.to_json(F.struct("*")).alias("report"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)

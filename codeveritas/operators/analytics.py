"""Numbers a report page derives from findings, files and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from .findings import severity_counts
from .scoring import ANOMALY


def severity_rank(severity: Column) -> Column:
    order = F.array(*[F.lit(s) for s in schemas.SEVERITIES])
    return F.array_position(order, severity)


def severity_summary(findings: DataFrame) -> DataFrame:
    """Count and first message per scan and severity; empty ones are absent.

    First means lowest (file, line, rule).
    """
    severity = F.lower(F.coalesce("severity", F.lit("info")))
    first = F.min(F.struct("file_path", "line_start", "rule_id", "message"))["message"]
    return (
        findings.withColumn("severity", severity)
        .where(F.col("severity").isin(schemas.SEVERITIES))
        .groupBy("scan_id", "severity")
        .agg(F.count("*").alias("findings"), first.alias("top_finding"))
        .withColumn("severity_rank", severity_rank(F.col("severity")).cast("bigint"))
    )


def finding_listing(findings: DataFrame) -> DataFrame:
    """Flat list with the base file name."""
    return findings.select(
        "scan_id",
        "file_path",
        text.base_name(F.col("file_path")).alias("file_name"),
        F.lower(F.coalesce("severity", F.lit("info"))).alias("severity"),
        "rule_id",
        F.col("line_start").cast("bigint").alias("line"),
    )


def severity_bars(findings: DataFrame) -> DataFrame:
    """Five counts, their total, and the bar scale (at least 1)."""
    columns = [F.col(f"{s}_count") for s in schemas.SEVERITIES]
    return (
        severity_counts(findings)
        .withColumn("total", sum(columns[1:], columns[0]))
        .withColumn("scale_max", F.greatest(*columns, F.lit(1).cast("bigint")))
    )


def kpis(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Total, critical, high and medium findings of every scan."""
    counted = findings.groupBy("scan_id").agg(
        F.count("*").alias("total_findings"),
        *[
            F.count_if(F.col("severity") == s).alias(f"{s}_findings")
            for s in ("critical", "high", "medium")
        ],
    )
    return scans.select("scan_id").distinct().join(counted, "scan_id", "left").fillna(0)


def flagged_file_pct(authorship: DataFrame) -> DataFrame:
    """Share of flagged files in percent and its band."""
    flagged = F.avg((F.col("ai_probability") > ANOMALY).cast("double")) * 100.0
    band = (
        F.when(F.col("flagged_pct") > 60, "high")
        .when(F.col("flagged_pct") > 30, "medium")
        .otherwise("low")
    )
    return authorship.groupBy("scan_id").agg(flagged.alias("flagged_pct")).withColumn(
        "band", band
    )


def score_bands(scores: DataFrame) -> DataFrame:
    """Gauge label of the score and card label of the rounded score."""
    score = F.col("trust_score")
    rounded = F.floor(score + 0.5)
    gauge = (
        F.when(score >= 80, "Excellent")
        .when(score >= 60, "Good")
        .when(score >= 40, "Moderate")
        .when(score >= 20, "Low")
        .otherwise("Critical")
    )
    card = F.when(rounded >= 70, "Good").when(rounded >= 40, "Needs Attention").otherwise(
        "High Risk"
    )
    return scores.withColumn("gauge", gauge).withColumn("card", card)


def probability_histogram(authorship: DataFrame) -> DataFrame:
    """Files per scan at the nearest of the five legend levels."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("ai_probability", F.lit(0.0))))
    level = F.floor(clamped * 4 + 0.5) / 4
    return authorship.groupBy("scan_id", level.alias("level")).agg(F.count("*").alias("files"))


def watermark_ratio(watermarks: DataFrame) -> DataFrame:
    """Verified files, all files, and whether all are verified."""
    return watermarks.groupBy("scan_id").agg(
        F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_files"),
        F.count("*").alias("total_files"),
    ).withColumn("all_verified", F.col("verified_files") == F.col("total_files"))


def _lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def stage_step(status: Column) -> Column:
    """The progress step of a stage; an unknown stage counts as the first."""
    return _lookup(schemas.STAGE_STEP, status, F.lit(schemas.STEPS[0]))


def stage_rollup(events: DataFrame) -> DataFrame:
    """Events per scan and progress step."""
    step = stage_step(F.col("status"))
    return (
        events.groupBy("scan_id", step.alias("step"))
        .agg(F.count("*").alias("events"))
        .withColumn(
            "step_index",
            (F.array_position(F.array(*[F.lit(s) for s in schemas.STEPS]), F.col("step")) - 1)
            .cast("bigint"),
        )
    )

"""Per-file authorship and the per-scan scores built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..sources.files import coerce_language
from . import heuristics, symbols
from .dependencies import penalised
from .symbols import KEY

# Pillar weights and the probability that flags a file.
WEIGHTS = {"authorship": 0.35, "findings": 0.40, "watermark": 0.25}
ANOMALY = 0.6


def with_text_figures(files: DataFrame, python: bool = False) -> DataFrame:
    """Adds the character entropy and word counts that ``base_probability`` needs of files in other
    languages; the entropy also of ``python`` ones, for the style features."""
    solid = ~text.is_blank(F.col("code"))
    scored = ~symbols.is_python() & solid
    levelled = heuristics.with_char_level(files, F.col("code"), solid if python else scored)
    return heuristics.with_text_counts(levelled, F.col("code"), scored)


def base_probability(
    code: Column, model_probability: Column | None = None, level: Column | None = None,
    counts: Column | None = None,
) -> Column:
    """Probability before the dependency penalty."""
    python = F.lit(0.5) if model_probability is None else F.coalesce(
        model_probability, F.lit(0.5)
    )
    given = [] if level is None else [level] if counts is None else [level, counts]
    return (
        F.when(text.is_blank(code), 0.0)
        .when(symbols.is_python(), python)
        .otherwise(arrays.let(heuristics.signals(code, *given), heuristics.mix))
    )


def detection_method(code: Column, model_probability: Column | None = None) -> Column:
    python = F.lit("ml_default") if model_probability is None else F.when(
        model_probability.isNull(), "ml_default"
    ).otherwise("ml_model")
    return (
        F.when(text.is_blank(code), "skipped")
        .when(symbols.is_python(), python)
        .otherwise("heuristic")
    )


def file_authorship(
    files: DataFrame,
    unknown: DataFrame | None = None,
    model_column: str | None = None,
) -> DataFrame:
    """One narrow row per file; the text is left behind.

    ``unknown`` are unknown import occurrences; ``model_column`` names a
    column of ``files`` with a trained model's probability.
    """
    code = F.col("code")
    model = F.col(model_column) if model_column else None
    rows = with_text_figures(coerce_language(files)).select(
        *KEY,
        "language",
        symbols.line_profile(code)["line_count"].alias("line_count"),
        symbols.function_total(code).alias("function_count"),
        base_probability(
            code, model, F.col(heuristics.LEVEL), F.col(heuristics.COUNTS)
        ).alias("base"),
        detection_method(code, model).alias("detection_method"),
    )
    return finish_authorship(rows, unknown)


def finish_authorship(rows: DataFrame, unknown: DataFrame | None) -> DataFrame:
    """Applies the penalty of unknown imports to the base probability."""
    if unknown is None:
        rows = rows.withColumn("unknown_imports", F.lit(0).cast("bigint"))
    else:
        per_file = unknown.groupBy(*KEY).agg(F.count("*").alias("unknown_imports"))
        rows = rows.join(per_file, KEY, "left").withColumn(
            "unknown_imports", F.coalesce("unknown_imports", F.lit(0).cast("bigint"))
        )
    probability = penalised(F.col("base"), F.col("unknown_imports"))
    return (
        rows.withColumn("ai_probability", probability)
        .withColumn("style_consistency", 1.0 - F.col("ai_probability"))
        .drop("base")
    )


def authorship_score(authorship: DataFrame) -> DataFrame:
    """Mean probability, flagged files and score per scan."""
    return (
        authorship.groupBy("scan_id")
        .agg(
            F.avg("ai_probability").alias("overall_ai_probability"),
            F.count_if(F.col("ai_probability") > ANOMALY).alias("style_anomaly_count"),
            F.count("*").alias("total_files"),
        )
        .withColumn(
            "authorship_score",
            F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col("overall_ai_probability"))),
        )
    )


def composite(authorship: Column, findings: Column, watermark: Column) -> Column:
    total = (
        authorship * WEIGHTS["authorship"]
        + findings * WEIGHTS["findings"]
        + watermark * WEIGHTS["watermark"]
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def trust_score(authorship: DataFrame, findings: DataFrame, watermark: DataFrame) -> DataFrame:
    """Joins the three per-scan scores; every scan of ``authorship`` appears."""
    return (
        authorship.select("scan_id", "authorship_score")
        .join(findings.select("scan_id", "findings_score"), "scan_id", "left")
        .join(watermark.select("scan_id", "watermark_score"), "scan_id", "left")
        .withColumn("findings_score", F.coalesce("findings_score", F.lit(100.0)))
        .withColumn("watermark_score", F.coalesce("watermark_score", F.lit(0.0)))
        .withColumn(
            "trust_score",
            F.round(
                composite(
                    F.col("authorship_score"), F.col("findings_score"), F.col("watermark_score")
                ),
                2,
            ),
        )
    )


def breakdown(scores: DataFrame) -> DataFrame:
    """Adds the three scores and their weights as one struct."""
    fields = []
    for pillar, weight in WEIGHTS.items():
        fields += [
            F.col(f"{pillar}_score").alias(f"{pillar}_score"),
            F.lit(weight).alias(f"{pillar}_weight"),
        ]
    return scores.withColumn("breakdown", F.struct(*fields))


def languages_detected(files: DataFrame) -> DataFrame:
    return coerce_language(files).groupBy("scan_id").agg(
        F.array_sort(F.collect_set("language")).alias("languages")
    )

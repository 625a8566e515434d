"""Findings from several sources: merge, de-duplicate, count, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..session import hot_key_parts
from .symbols import KEY

# Severity names of external rule engines, and the words that
# make a file worth a closer review.
ENGINE_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
REVIEW_WORDS = ["openai", "llm", "prompt", "gpt", "anthropic", "langchain"]
REVIEW_CHARS = 4000

SOURCE_RANK = {"structural": 0, "line": 1, "external": 2}


def map_severity(severity: Column) -> Column:
    upper = F.upper(severity)
    mapped = F.lit("medium")
    for name, level in ENGINE_SEVERITY.items():
        mapped = F.when(upper == name, F.lit(level)).otherwise(mapped)
    return mapped


def categorize(rule_id: Column) -> Column:
    """Category of a foreign finding, guessed from its rule id."""
    name = F.lower(rule_id)

    def mentions(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [name.contains(w) for w in words])

    return (
        F.when(mentions("prompt", "injection"), F.lit("prompt_injection"))
        .when(mentions("hallucin"), F.lit("hallucinated_dependency"))
        .when(mentions("secret", "key"), F.lit("hardcoded_secret"))
        .when(mentions("llm", "ai"), F.lit("insecure_llm_call"))
        .otherwise(F.lit("unvalidated_ai_output"))
    )


def complete_foreign(findings: DataFrame) -> DataFrame:
    """Maps engine severities and fills missing categories."""
    severity = F.when(
        F.lower("severity").isin(schemas.SEVERITIES), F.lower("severity")
    ).otherwise(map_severity(F.col("severity")))
    return findings.withColumn("severity", severity).withColumn(
        "category", F.coalesce("category", categorize(F.col("rule_id")))
    )


def union_findings(**sources: DataFrame) -> DataFrame:
    """Concatenates sources named as in ``SOURCE_RANK``."""
    ranked = [
        df.withColumn("source_rank", F.lit(SOURCE_RANK[name])) for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, ranked)


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per (scan, file, line, rule), the lowest source rank wins.

    A minimum over a struct combines map-side, so repeats shrink before they
    are shuffled.
    """
    key = [*KEY, "line_start", "rule_id"]
    rest = [c for c in findings.columns if c not in key and c != "source_rank"]
    best = F.min(F.struct("source_rank", *rest)).alias("best")
    return findings.groupBy(*key).agg(best).select(*key, "best.*")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Five zero-filled counts per scan that has findings."""
    return findings.groupBy("scan_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in schemas.SEVERITIES]
    )


def score_of_counts() -> Column:
    penalty = sum(
        (F.coalesce(F.col(f"{s}_count"), F.lit(0)) * p
         for s, p in schemas.SEVERITY_PENALTY.items()),
        F.lit(0.0),
    )
    return F.greatest(F.lit(0.0), F.lit(100.0) - penalty)


def findings_score(counts: DataFrame, scans: DataFrame) -> DataFrame:
    """Score per scan; a scan without findings keeps 100."""
    zero_filled = {f"{s}_count": 0 for s in schemas.SEVERITIES}
    return (
        scans.select("scan_id").distinct()
        .join(counts, "scan_id", "left")
        .fillna(zero_filled)
        .withColumn("findings_score", score_of_counts())
    )


def review_candidates(files: DataFrame, n: int = 10) -> DataFrame:
    """Of the first ``n`` files of every scan, those that mention model use.

    The rank limit is applied inside every input partition before the shuffle,
    and only the review excerpt travels.  It is applied in slices of a scan
    first, so what the partitions send of a huge scan does not meet in one task.
    """
    lowered = F.lower("content")
    mentions = reduce(lambda a, b: a | b, [lowered.contains(w) for w in REVIEW_WORDS])
    narrow = files.select(
        *KEY, mentions.alias("relevant"), F.substring("content", 1, REVIEW_CHARS).alias("excerpt")
    )

    def first_n(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("file_path"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= n)

    sliced = narrow.withColumn("slice", F.pmod(F.xxhash64("file_path"), F.lit(hot_key_parts(files))))
    return (
        first_n(first_n(sliced, "scan_id", "slice"), "scan_id")
        .where("relevant")
        .select(*KEY, "excerpt")
    )


def parse_external_findings(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Findings out of JSON replies, one reply per file.

    A reply that is not a JSON array, or that has a severity or category
    outside the enumerations, yields nothing for its file.
    """
    parsed = F.from_json(F.col(column), schemas.EXTERNAL_FINDING)
    is_array = F.schema_of_variant(F.try_parse_json(column)).startswith("ARRAY")
    severity = lambda f: F.coalesce(f["severity"], F.lit("medium"))
    category = lambda f: F.coalesce(f["category"], F.lit("insecure_llm_call"))
    valid = F.forall(
        parsed,
        lambda f: severity(f).isin(schemas.SEVERITIES) & category(f).isin(schemas.CATEGORIES),
    )
    rows = F.transform(
        parsed,
        lambda f: F.struct(
            F.concat(F.lit("semantic."), F.coalesce(f["category"], F.lit("unknown"))).alias(
                "rule_id"
            ),
            category(f).alias("category"),
            severity(f).alias("severity"),
            F.coalesce(f["line"], F.lit(0)).alias("line_start"),
            F.coalesce(f["line"], F.lit(0)).alias("line_end"),
            F.coalesce(f["message"], F.lit("")).alias("message"),
            F.lit(None).cast("string").alias("snippet"),
            f["fix"].alias("fix_suggestion"),
        ),
    )
    return replies.where(F.coalesce(is_array & valid, F.lit(False))).select(*KEY, F.inline(rows))


def imports_as_findings(imports: DataFrame) -> DataFrame:
    """Structural import rules: every import of a public-looking package name."""
    # Rule ids and accepted names.
    bare = F.col("module").rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
    dotted = F.col("module").rlike(r"^[a-zA-Z_][a-zA-Z0-9_.]*$")
    npm = F.col("module").rlike(r"^[a-zA-Z@][a-zA-Z0-9./_-]*$")
    rule = (
        F.when((F.col("registry") == "npm") & F.col("is_from") & npm, F.lit("ai-hallucinated-npm-import"))
        .when((F.col("registry") == "pypi") & F.col("is_from") & dotted,
              F.lit("ai-hallucinated-import-from"))
        .when((F.col("registry") == "pypi") & ~F.col("is_from") & bare,
              F.lit("ai-hallucinated-import"))
    )
    return imports.withColumn("rule_id", rule).where(F.col("rule_id").isNotNull()).select(
        *KEY,
        "rule_id",
        F.lit("hallucinated_dependency").alias("category"),
        map_severity(F.lit("WARNING")).alias("severity"),
        F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"),
        F.concat(F.lit("Check that the package exists: "), "module").alias("message"),
        text.strip(F.col("module")).alias("snippet"),
        F.lit(None).cast("string").alias("fix_suggestion"),
    )

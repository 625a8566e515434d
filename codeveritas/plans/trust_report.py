"""The whole scan as one plan.

``file_facts`` reads every file once and keeps what later steps need as a
narrow row: scores, counts, imports, findings and watermark payload, but no
text.  Everything after it works on these rows only.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import (
    dependencies, ensemble, findings, heuristics, rules, scoring, scripts, structural, style,
    symbols, syntax, watermark,
)
from ..operators.symbols import KEY
from ..session import hot_key_parts, write_and_read
from ..sources.files import coerce_language


def _with_trees(files: DataFrame, model: ensemble.Ensemble | None, structural_rules: bool) -> DataFrame:
    """Adds tokens and nodes of the files that need them, each parsed once.

    A trained model needs them of every Python file, the structural rules of
    those only whose text holds a word that a rule looks for.
    """
    rules_apply = structural.may_match_python() if structural_rules else F.lit(False)
    parsed = symbols.is_python() if model is not None else rules_apply
    added = {"nodes": syntax.python_nodes(F.when(parsed, F.col("code")))}
    if model is not None:
        added["tokens"] = syntax.python_tokens(F.when(parsed, F.col("code")))
    if structural_rules:
        added["script_tokens"] = scripts.script_tokens(
            F.when(structural.may_match_js(), F.col("content"))
        )
    out = files.withColumns(added)
    if structural_rules:
        out = out.withColumn("tries", structural.try_nodes(F.col("nodes")))
        out = out.withColumn("structural", F.concat(
            F.when(rules_apply, structural.python_finding_array()).otherwise(F.array().cast(rules.FINDING_ARRAY)),
            structural.js_finding_array(),
        ))
    if model is not None:
        code = F.col("code")
        out = out.withColumn("style", F.when(
            symbols.is_python() & ~text.is_blank(code),
            style.feature_struct(code, F.col("tokens"), F.col("nodes"), F.col(heuristics.LEVEL)),
        ))
        out = out.withColumn("model_input", F.when(
            F.col("style").isNotNull(), style.feature_array(F.col("style"), model.features)
        ))
    return out


def file_facts(
    files: DataFrame,
    *,
    bits: int = watermark.DEFAULT_BITS,
    model: ensemble.Ensemble | None = None,
    structural_rules: bool = False,
    line_rules: list[dict] = rules.LINE_RULES,
) -> DataFrame:
    """One row per prepared file, computed where the file is read.

    ``model`` is a compiled ensemble (``ensemble.compile_model``): features and
    probability of Python files are then derived in the same pass, as are the
    findings of the structural rules.
    """
    code, content = F.col("code"), F.col("content")
    files = scoring.with_text_figures(coerce_language(files), python=model is not None)
    if model is not None or structural_rules:
        files = _with_trees(files, model, structural_rules)
    scored = None
    if model is not None:
        scored = F.when(
            F.col("model_input").isNotNull(), ensemble.probability(model, F.col("model_input"))
        )
    return files.select(
        *KEY,
        "language",
        "size_bytes",
        symbols.line_profile(code)["line_count"].alias("line_count"),
        symbols.function_total(code).alias("function_count"),
        scoring.base_probability(
            code, scored, F.col(heuristics.LEVEL), F.col(heuristics.COUNTS)
        ).alias("base"),
        scoring.detection_method(code, scored).alias("detection_method"),
        symbols.import_array(code).alias("imports"),
        rules.finding_array(content, line_rules).alias("findings"),
        *([F.col("structural")] if structural_rules else []),
        watermark.extracted_payload(content, bits).alias("payload"),
    )


def imports_of(facts: DataFrame) -> DataFrame:
    return facts.select(*KEY, "language", F.inline("imports"))


def findings_of(facts: DataFrame) -> DataFrame:
    return facts.select(*KEY, F.inline("findings"))


def structural_of(facts: DataFrame) -> DataFrame:
    """Findings of the structural rules and of the import rules, from the facts."""
    return facts.select(*KEY, F.inline("structural")).unionByName(
        findings.imports_as_findings(imports_of(facts))
    )


class ScanTables:
    """The tables of a finished scan, each a lazy DataFrame over the facts."""

    def __init__(
        self,
        facts: DataFrame,
        registry: DataFrame,
        claims: DataFrame | None,
        extra_findings: dict[str, DataFrame],
        bits: int,
    ) -> None:
        self.facts = facts
        self.unknown_dependencies = dependencies.unknown_dependencies(
            imports_of(facts), registry
        )
        narrow = facts.select(
            *KEY, "language", "line_count", "function_count", "base", "detection_method"
        )
        self.authorship = scoring.finish_authorship(narrow, self.unknown_dependencies)
        line_findings = findings_of(facts)
        if extra_findings:
            merged = findings.union_findings(line=line_findings, **extra_findings)
            self.findings = findings.dedup_findings(merged)
        else:
            # One source cannot report the same line and rule twice.
            self.findings = line_findings
        extracted = facts.select(*KEY, "payload")
        if claims is None:
            verified = extracted.select(
                *KEY,
                F.col("payload").isNotNull().alias("is_watermarked"),
                F.lit(False).alias("has_claim"),
                F.lit(None).cast("boolean").alias("verified"),
                F.lit(None).cast("string").alias("author_hash"),
            )
        else:
            verified = watermark.verify_watermark(extracted, claims, bits)
        self.watermarks = watermark.watermark_confidence(verified)

    def scores(self) -> DataFrame:
        """One row per scan: the three scores, the trust score, totals, languages."""
        per_scan = self.facts.groupBy("scan_id").agg(
            F.count("*").alias("total_files"),
            F.sum("line_count").alias("total_lines"),
            F.array_sort(F.collect_set("language")).alias("languages"),
        )
        authorship = scoring.authorship_score(self.authorship).drop("total_files")
        marks = watermark.watermark_score(self.watermarks).drop("total_files")
        counts = findings.severity_counts(self.findings)
        joined = (
            per_scan.join(authorship, "scan_id", "left")
            .join(marks, "scan_id", "left")
            .join(counts, "scan_id", "left")
            .fillna({f"{s}_count": 0 for s in schemas.SEVERITIES})
            .withColumn("findings_score", findings.score_of_counts())
        )
        total = scoring.composite(
            F.col("authorship_score"), F.col("findings_score"), F.col("watermark_score")
        )
        return joined.withColumn("trust_score", F.round(total, 2))


def scan_corpus(
    files: DataFrame,
    registry: DataFrame,
    *,
    claims: DataFrame | None = None,
    structural_rules: bool = False,
    external_findings: DataFrame | None = None,
    model: PipelineModel | ensemble.Ensemble | None = None,
    bits: int = watermark.DEFAULT_BITS,
) -> ScanTables:
    """Runs a scan over prepared files.

    The facts are written once to the shared scratch folder: they feed five
    roll-ups, and re-deriving them would re-read and re-score all text.  With a
    trained ``model``, structural rules or both it is still one pass.
    """
    if isinstance(model, PipelineModel):
        model = ensemble.compile_model(files.sparkSession, model)
    facts = write_and_read(
        file_facts(files, bits=bits, model=model, structural_rules=structural_rules), "file-facts"
    )
    extra: dict[str, DataFrame] = {}
    if structural_rules:
        extra["structural"] = structural_of(facts)
    if external_findings is not None:
        extra["external"] = external_findings
    return ScanTables(facts, registry, claims, extra, bits)


def trust_report(tables: ScanTables, generated_at: Column | None = None) -> DataFrame:
    """Report header per scan: score, breakdown, counts, languages."""
    stamp = F.current_timestamp() if generated_at is None else generated_at
    return scoring.breakdown(tables.scores()).withColumn("generated_at", stamp)


REPORT_PART_ROWS = 1000


def report_parts(
    section: str, rows: DataFrame, order: list[str], per_part: int = REPORT_PART_ROWS
) -> DataFrame:
    """A report section as arrays of about ``per_part`` rows.

    One array per scan would put a huge scan into one row.  The number of
    parts follows the scan's row count and rows are dealt by hash, so every
    row is kept and no group grows with the scan.  The part count of a scan is
    joined back salted, as one scan may hold a third of the rows.
    """
    salts = hot_key_parts(rows)
    sized = (
        rows.groupBy("scan_id")
        .agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    spot = F.xxhash64(*order)
    part = F.pmod(spot, F.col("parts")).cast("int")
    columns = [c for c in rows.columns if c != "scan_id"]
    ordered = [F.col(c) for c in order] + [F.col(c) for c in columns if c not in order]
    return (
        rows.withColumn("salt", F.pmod(F.shiftright(spot, 32), F.lit(salts)).cast("int"))
        .join(sized, ["scan_id", "salt"])
        .groupBy("scan_id", part.alias("part"))
        .agg(F.to_json(F.array_sort(F.collect_list(F.struct(*ordered)))).alias("items"))
        .select("scan_id", F.lit(section).alias("section"), "part", "items")
    )


def full_report(tables: ScanTables, generated_at: Column | None = None) -> DataFrame:
    """Header and detail sections of every scan as JSON parts."""
    header = trust_report(tables, generated_at)
    head = header.select(
        "scan_id",
        F.lit("header").alias("section"),
        F.lit(0).alias("part"),
        F.to_json(F.struct(*[c for c in header.columns if c != "scan_id"])).alias("items"),
    )
    sections = [
        report_parts("file_analyses", tables.authorship, ["file_path"]),
        report_parts(
            "unknown_dependencies",
            tables.unknown_dependencies,
            ["file_path", "line_no", "package_name"],
        ),
        report_parts(
            "findings", tables.findings, ["file_path", "line_start", "rule_id"]
        ),
        report_parts("watermarks", tables.watermarks, ["file_path"]),
    ]
    for section in sections:
        head = head.unionByName(section)
    return head


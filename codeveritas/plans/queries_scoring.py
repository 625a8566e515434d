"""Registered queries: scores, reports and report analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import analytics, dependencies, rules, scoring, symbols, training, watermark
from ..operators.symbols import KEY
from . import oracle as o
from . import trust_report as plan
from . import views
from .catalog import query
from .oracle import with_
from .queries_corpus import r6

_ALL = [*o.CODE, *o.PILLARS]
_MARKED = [*o.PLAIN, *o.WATERMARK]


def _tables(spark, sf):
    return plan.scan_corpus(views.code(spark, sf), views.registry(spark, sf), bits=views.BITS)


def _authorship(spark, sf):
    code = views.code(spark, sf)
    unknown = dependencies.unknown_dependencies(
        symbols.imports(code), views.registry(spark, sf)
    )
    return scoring.file_authorship(code, unknown)


@query("file_authorship", with_(*_ALL) + " SELECT scan_id, file_path, language, line_count, "
       "function_count, unknown_imports, detection_method, round(ai_probability, 6) "
       "AS ai_probability, round(1 - ai_probability, 6) AS style_consistency FROM authorship")
def _(spark, sf):
    return _authorship(spark, sf).select(
        *KEY, "language", "line_count", "function_count", "unknown_imports", "detection_method",
        r6("ai_probability"), r6("style_consistency"),
    )


@query("authorship_score", with_(*_ALL) + " SELECT scan_id, total_files, "
       "round(overall_ai_probability, 6) AS overall_ai_probability, style_anomaly_count, "
       "round(authorship_score, 6) AS authorship_score FROM authorship_scores")
def _(spark, sf):
    rows = scoring.authorship_score(_authorship(spark, sf))
    return rows.select(
        "scan_id", "total_files", r6("overall_ai_probability"), "style_anomaly_count",
        r6("authorship_score"),
    )


_TRUST_COLUMNS = (
    "scan_id, total_files, total_lines, languages, round(authorship_score, 6) "
    "AS authorship_score, findings_score, watermark_score, critical_count, high_count, "
    "medium_count, low_count, info_count, trust_score"
)


@query("trust_score", with_(*_ALL, o.TRUST) + f" SELECT {_TRUST_COLUMNS} FROM trust "
       "JOIN authorship_scores USING (scan_id, authorship_score) "
       "JOIN finding_scores USING (scan_id, findings_score)")
def trust_score(spark, sf):
    rows = _tables(spark, sf).scores()
    return rows.select(
        "scan_id", "total_files", "total_lines",
        F.array_join("languages", ",").alias("languages"), r6("authorship_score"),
        "findings_score", "watermark_score", *[f"{s}_count" for s in schemas.SEVERITIES],
        "trust_score",
    )


@query("trust_score_marked", with_(*o.PLAIN, *o.WATERMARK, o.WATERMARK_SCORES, *o.PILLARS)
       + " SELECT scan_id, round(a.authorship_score, 6) AS authorship_score, findings_score, "
       "round(watermark_score, 6) AS watermark_score, verified_files, round(0.35 * "
       "a.authorship_score + 0.4 * findings_score + 0.25 * watermark_score, 2) AS trust_score "
       "FROM authorship_scores a JOIN finding_scores USING (scan_id) "
       "JOIN watermark_scores USING (scan_id)")
def _(spark, sf):
    tables = plan.scan_corpus(
        views.marked(spark, sf), views.registry(spark, sf), claims=views.claims(spark, sf),
        bits=views.BITS,
    )
    return tables.scores().select(
        "scan_id", r6("authorship_score"), "findings_score", r6("watermark_score"),
        "verified_files", "trust_score",
    )


@query("trust_score_joined", with_(*_ALL, o.TRUST) + " SELECT scan_id, findings_score, "
       "trust_score FROM trust")
def _(spark, sf):
    from ..operators import findings

    code = views.code(spark, sf)
    authorship = scoring.authorship_score(_authorship(spark, sf))
    counts = findings.severity_counts(rules.scan_rules(code))
    extracted = watermark.extract_watermark(code, views.BITS)
    no_claims = views.claims(spark, sf).where("false")
    marks = watermark.watermark_score(
        watermark.verify_watermark(extracted, no_claims, views.BITS)
    )
    scores = scoring.trust_score(authorship, findings.findings_score(counts, code), marks)
    return scores.select("scan_id", "findings_score", "trust_score")


@query("breakdown", with_(*_ALL, o.TRUST) + " SELECT scan_id, round(authorship_score, 6) "
       "AS authorship_score, 0.35::DOUBLE AS authorship_weight, findings_score, 0.40::DOUBLE "
       "AS findings_weight, watermark_score::DOUBLE AS watermark_score, 0.25::DOUBLE "
       "AS watermark_weight FROM trust")
def _(spark, sf):
    rows = scoring.breakdown(_tables(spark, sf).scores()).select("scan_id", "breakdown.*")
    return rows.withColumn("authorship_score", F.round("authorship_score", 6))


@query("languages_detected", with_(*o.CODE) + " SELECT scan_id, string_agg(DISTINCT language, ',' "
       "ORDER BY language) AS languages FROM files GROUP BY 1")
def _(spark, sf):
    rows = scoring.languages_detected(views.code(spark, sf))
    return rows.withColumn("languages", F.array_join("languages", ","))


@query("full_report", with_(*_ALL) + " SELECT scan_id, 'header' AS section, 1::BIGINT AS items "
       "FROM authorship_scores UNION ALL SELECT scan_id, 'file_analyses', count(*) "
       "FROM authorship GROUP BY 1 UNION ALL SELECT scan_id, 'unknown_dependencies', count(*) "
       "FROM unknown GROUP BY 1 UNION ALL SELECT scan_id, 'findings', count(*) FROM findings "
       "GROUP BY 1 UNION ALL SELECT scan_id, 'watermarks', count(*) FROM files GROUP BY 1")
def _(spark, sf):
    parts = plan.full_report(_tables(spark, sf), F.lit("2024-01-31").cast("timestamp"))
    items = F.when(F.col("section") == "header", F.lit(1)).otherwise(
        F.coalesce(F.json_array_length("items"), F.lit(0))
    )
    return parts.groupBy("scan_id", "section").agg(F.sum(items).cast("bigint").alias("items"))


# Modules: every file is Python, imports one unknown package, and has one or two structural findings
# in its closing statement and one for each of its two imports.  A comment line that is empty but for
# its sign ends in a space, so a file with as many as a mark has bits counts as marked.
_MODULES = [
    o.base(views.MODULE_COLUMNS),
    "files AS (SELECT *, 'python' AS language FROM raw)",
    o.LINES,
    o.FINDINGS.replace("findings AS (", "line_findings AS (", 1),
    "structural AS (SELECT scan_id, unnest(CASE doc_id % 7 WHEN 0 THEN ['high'] WHEN 1 THEN "
    "['medium', 'low'] WHEN 3 THEN ['high'] WHEN 4 THEN ['high'] WHEN 5 THEN ['high'] ELSE [] END "
    "|| ['medium', 'medium']) AS severity FROM files)",
    "findings AS (SELECT scan_id, severity FROM line_findings UNION ALL SELECT * FROM structural)",
    o.SEVERITY,
    o.FINDING_SCORES,
    f"ends AS (SELECT doc_id, count(*) FILTER (WHERE rtrim(line, {o.SPACE}) <> '' AND substr(line, "
    f"length(rtrim(line, {o.SPACE})) + 1, 1) IN (' ', chr(9))) AS n, count(*) AS line_count "
    "FROM lines GROUP BY 1)",
    f"totals AS (SELECT scan_id, count(*) AS total_files, sum(line_count)::BIGINT AS total_lines, "
    f"count(*) FILTER (WHERE n >= {views.BITS}) / count(*) * 100.0 AS watermark_score "
    "FROM files JOIN ends USING (doc_id) GROUP BY 1)",
]


@query("scan_corpus_structural", with_(*_MODULES) + " SELECT scan_id, total_files, total_lines, "
       "'python' AS languages, 40.0 AS authorship_score, findings_score, round(watermark_score, 6) "
       "AS watermark_score, critical_count, high_count, medium_count, low_count, info_count, "
       "round(0.35 * 40.0 + 0.4 * findings_score + 0.25 * watermark_score, 2) AS trust_score "
       "FROM totals JOIN finding_scores USING (scan_id)")
def _(spark, sf):
    tables = plan.scan_corpus(
        views.modules(spark, sf), views.registry(spark, sf), structural_rules=True,
        bits=views.BITS,
    )
    return tables.scores().select(
        "scan_id", "total_files", "total_lines",
        F.array_join("languages", ",").alias("languages"), r6("authorship_score"),
        "findings_score", r6("watermark_score"), *[f"{s}_count" for s in schemas.SEVERITIES],
        "trust_score",
    )


@query("scan_with_model", "SELECT source AS scan_id, concat(source, '/src/m', doc_id, '.py') AS "
       "file_path, 'ml_model' AS detection_method, 1::BIGINT AS unknown_imports, true AS agrees "
       "FROM documents")
def _(spark, sf):
    # The compiled model inside the scan against the fitted pipeline over the feature table.
    from .queries_learning import module_model

    model, features = module_model(spark, sf)
    tables = plan.scan_corpus(
        views.modules(spark, sf), views.registry(spark, sf), model=model, structural_rules=True,
        bits=views.BITS,
    )
    direct = training.predict(model, features).select(*KEY, F.col("probability").alias("direct"))
    penalised = dependencies.penalised(F.col("direct"), F.col("unknown_imports"))
    return tables.authorship.join(direct, KEY).select(
        *KEY, "detection_method", "unknown_imports",
        (F.abs(F.col("ai_probability") - penalised) <= 1e-9).alias("agrees"),
    )


# ---------------------------------------------------------------------------
# Analytics
# ---------------------------------------------------------------------------

_FINDINGS = [*o.CODE, o.LINES, o.FINDINGS]
_RANK = "list_position(['critical', 'high', 'medium', 'low', 'info'], severity)"


def _line_findings(spark, sf):
    return rules.scan_rules(views.code(spark, sf))


@query("severity_summary", with_(*_FINDINGS) + " SELECT scan_id, severity, count(*) AS findings, "
       "arg_min(message, row(file_path, line_start, rule_id)) AS top_finding, "
       f"{_RANK}::BIGINT AS severity_rank FROM findings GROUP BY scan_id, severity")
def _(spark, sf):
    return analytics.severity_summary(_line_findings(spark, sf))


@query("finding_listing", with_(*_FINDINGS) + " SELECT scan_id, file_path, "
       "string_split(file_path, '/')[3] AS file_name, severity, rule_id, line_start AS line "
       "FROM findings")
def _(spark, sf):
    return analytics.finding_listing(_line_findings(spark, sf))


_SUM = " + ".join(f"{s}_count" for s in schemas.SEVERITIES)
_LIST = ", ".join(f"{s}_count" for s in schemas.SEVERITIES)


@query("severity_bars", with_(*_FINDINGS, o.SEVERITY) + f" SELECT scan_id, {_LIST}, {_SUM} "
       f"AS total, greatest({_LIST}, 1) AS scale_max FROM severity_counts")
def _(spark, sf):
    return analytics.severity_bars(_line_findings(spark, sf))


@query("kpis", with_(*_FINDINGS) + " SELECT f.scan_id, count(g.rule_id) AS total_findings, "
       + ", ".join(f"count(*) FILTER (WHERE g.severity = '{s}') AS {s}_findings"
                   for s in ("critical", "high", "medium"))
       + " FROM (SELECT DISTINCT scan_id FROM files) f LEFT JOIN findings g USING (scan_id) "
       "GROUP BY 1")
def _(spark, sf):
    code = views.code(spark, sf)
    return analytics.kpis(rules.scan_rules(code), code)


@query("flagged_file_pct", with_(*_ALL) + " SELECT scan_id, round(p, 6) AS flagged_pct, CASE "
       "WHEN p > 60 THEN 'high' WHEN p > 30 THEN 'medium' ELSE 'low' END AS band FROM (SELECT "
       "scan_id, 100.0 * avg(CASE WHEN ai_probability > 0.6 THEN 1.0 ELSE 0.0 END) AS p "
       "FROM authorship GROUP BY 1)")
def _(spark, sf):
    rows = analytics.flagged_file_pct(_authorship(spark, sf))
    return rows.withColumn("flagged_pct", F.round("flagged_pct", 6))


@query("score_bands", with_(*_ALL, o.TRUST) + " SELECT scan_id, trust_score, CASE "
       "WHEN trust_score >= 80 THEN 'Excellent' WHEN trust_score >= 60 THEN 'Good' "
       "WHEN trust_score >= 40 THEN 'Moderate' WHEN trust_score >= 20 THEN 'Low' "
       "ELSE 'Critical' END AS gauge, CASE WHEN trust_score >= 69.5 THEN 'Good' "
       "WHEN trust_score >= 39.5 THEN 'Needs Attention' ELSE 'High Risk' END AS card FROM trust")
def _(spark, sf):
    scores = _tables(spark, sf).scores().select("scan_id", "trust_score")
    return analytics.score_bands(scores)


@query("probability_histogram", with_(*_ALL) + " SELECT scan_id, floor(ai_probability * 4 + 0.5) "
       "/ 4 AS level, count(*) AS files FROM authorship GROUP BY 1, 2")
def _(spark, sf):
    return analytics.probability_histogram(_authorship(spark, sf))


@query("watermark_ratio", with_(*_MARKED) + " SELECT scan_id, count(*) FILTER (WHERE verified) "
       "AS verified_files, count(*) AS total_files, count(*) FILTER (WHERE verified) = count(*) "
       "AS all_verified FROM verified GROUP BY 1")
def _(spark, sf):
    extracted = watermark.extract_watermark(views.marked(spark, sf), views.BITS)
    verified = watermark.verify_watermark(extracted, views.claims(spark, sf), views.BITS)
    return analytics.watermark_ratio(verified)


@query("stage_rollup", with_(o.EVENTS) + " SELECT scan_id, step, CASE step WHEN 'queued' THEN 0 "
       "WHEN 'ingesting' THEN 1 WHEN 'analyzing' THEN 2 ELSE 4 END::BIGINT AS step_index, "
       "count(*) AS events FROM (SELECT *, CASE status WHEN 'queued' THEN 'queued' WHEN 'cloning' "
       "THEN 'ingesting' WHEN 'authorship' THEN 'analyzing' ELSE 'completed' END AS step "
       "FROM scan_events) GROUP BY 1, 2, 3")
def _(spark, sf):
    return analytics.stage_rollup(views.scan_events(spark, sf))


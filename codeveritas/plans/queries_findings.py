"""Registered queries: dependencies, findings and watermarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import dependencies, findings, rule_index, rules, structural, symbols, watermark
from ..operators.symbols import KEY
from ..session import scratch_dir
from . import oracle as o
from . import views
from .catalog import query
from .oracle import q, qlist, with_
from .queries_corpus import long

_IMPORTS = [*o.CODE, o.LINES, o.PY_IMPORT_LINES, o.IMPORTS]
_DEPS = [*o.CODE, o.LINES, *o.DEPS]


def _imports(spark, sf):
    return symbols.imports(views.code(spark, sf))


@query("root_package", with_(*_DEPS) + " SELECT scan_id, file_path, registry, module, package, "
       "line_no FROM rooted")
def _(spark, sf):
    rows = dependencies.root_package(_imports(spark, sf))
    return rows.select(*KEY, "registry", "module", "package", long("line_no"))


@query("skip_stdlib", with_(*_DEPS) + " SELECT scan_id, file_path, registry, module, line_no "
       "FROM rooted WHERE NOT (registry = 'pypi' AND package IN "
       f"{qlist(dependencies.PYTHON_STDLIB)})")
def _(spark, sf):
    rows = dependencies.skip_stdlib(dependencies.root_package(_imports(spark, sf)))
    return rows.select(*KEY, "registry", "module", long("line_no"))


@query("skip_relative", with_(*_IMPORTS) + " SELECT scan_id, file_path, registry, module, line_no "
       "FROM imports WHERE NOT (registry = 'npm' AND starts_with(module, '.'))")
def _(spark, sf):
    rows = dependencies.skip_relative(_imports(spark, sf))
    return rows.select(*KEY, "registry", "module", long("line_no"))


@query("unknown_dependencies", with_(*_DEPS) + " SELECT scan_id, file_path, module "
       "AS package_name, line_no, registry FROM unknown")
def _(spark, sf):
    rows = dependencies.unknown_dependencies(_imports(spark, sf), views.registry(spark, sf))
    return rows.select(*KEY, "package_name", long("line_no"), "registry")


@query("registry_fail_open", with_(*_DEPS) + " SELECT registry, count(*) AS unknown_imports "
       "FROM unknown WHERE registry = 'npm' GROUP BY 1")
def _(spark, sf):
    npm_only = views.registry(spark, sf).where("registry = 'npm'")
    rows = dependencies.unknown_dependencies(_imports(spark, sf), npm_only)
    return rows.groupBy("registry").agg(F.count("*").alias("unknown_imports"))


@query("dependency_penalty", with_(*_DEPS) + " SELECT f.scan_id, f.file_path, coalesce(u.n, 0) "
       "AS unknown_imports, round(least(1.0, (doc_id % 11) / 10.0 + 0.1 * coalesce(u.n, 0)), 6) "
       "AS ai_probability FROM files f LEFT JOIN (SELECT doc_id, count(*) AS n FROM unknown "
       "GROUP BY 1) u USING (doc_id)")
def _(spark, sf):
    code = views.code(spark, sf)
    unknown = dependencies.unknown_dependencies(
        symbols.imports(code), views.registry(spark, sf)
    )
    given = code.select(*KEY, (F.col("doc_id") % 11 / 10.0).alias("ai_probability"))
    rows = dependencies.dependency_penalty(given, unknown)
    return rows.select(
        *KEY, "unknown_imports", F.round("ai_probability", 6).alias("ai_probability")
    )


# ---------------------------------------------------------------------------
# Findings
# ---------------------------------------------------------------------------

_FINDINGS = [*o.CODE, o.LINES, o.FINDINGS]
_COLUMNS = [*KEY, "rule_id", "category", "severity", "line_start", "message", "snippet",
            "fix_suggestion"]


def _line_findings(spark, sf):
    return rules.scan_rules(views.code(spark, sf))


@query("scan_rules", with_(*_FINDINGS) + f" SELECT {', '.join(_COLUMNS)} FROM findings")
def _(spark, sf):
    return _line_findings(spark, sf).select(
        *[long(c) if c == "line_start" else c for c in _COLUMNS]
    )


@query("scan_rules_plain", with_(*o.PLAIN, o.LINES, o.FINDINGS)
       + " SELECT scan_id, file_path, rule_id, line_start FROM findings")
def _(spark, sf):
    found = rules.scan_rules(views.files(spark, sf))
    return found.select(*KEY, "rule_id", long("line_start"))


@query("scan_rules_pages", "WITH lines AS (SELECT page_id AS doc_id, 'web' AS scan_id, "
       "concat('p', page_id, '.html') AS file_path, unnest(string_split(html, chr(10))) AS line, "
       "generate_subscripts(string_split(html, chr(10)), 1) AS line_no FROM (SELECT page_id, "
       "replace(replace(html, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS html "
       f"FROM pages)), {o.FINDINGS} SELECT concat('p', page_id, '.html') AS file_path, coalesce(n, 0) "
       "AS matches FROM pages LEFT JOIN (SELECT doc_id, count(*) AS n FROM findings GROUP BY 1) "
       "ON doc_id = page_id")
def _(spark, sf):
    from ..sources.files import prepare, read_table_as_files

    pages = read_table_as_files(
        views.table(spark, sf, "pages"), F.lit("web"),
        F.concat(F.lit("p"), "page_id", F.lit(".html")), F.col("html"),
    )
    found = rules.finding_array(F.col("content"))
    return prepare(pages).select("file_path", F.size(found).cast("bigint").alias("matches"))


@query("rule_hit_counts", with_(*_FINDINGS) + " SELECT scan_id, rule_id, count(*) AS matches "
       "FROM findings GROUP BY 1, 2")
def _(spark, sf):
    return rules.rule_hit_counts(views.code(spark, sf))


@query("rules_from_table", with_(*o.CODE, o.LINES) + " SELECT scan_id, file_path, "
       "concat('nation-', n_nationkey) AS rule_id, line_no AS line_start FROM lines, nation "
       "WHERE regexp_matches(line, concat('pkg_', n_nationkey, '[^0-9]'))")
def _(spark, sf):
    table = views.table(spark, sf, "nation").select(
        F.concat(F.lit("nation-"), "n_nationkey").alias("rule_id"),
        F.concat(F.lit("pkg_"), "n_nationkey", F.lit("[^0-9]")).alias("pattern"),
        F.lit("insecure_llm_call").alias("category"),
        F.lit("info").alias("severity"),
        F.lit("named package").alias("message"),
        F.lit(None).cast("string").alias("fix"),
    )
    found = rules.scan_rules(views.code(spark, sf), rules.rules_from_table(table))
    return found.select(*KEY, "rule_id", long("line_start"))


# A rule for every part: thousands of patterns, one of which most lines cannot match.
@query("scan_rule_table", with_(*o.CODE, o.LINES) + ", named AS (SELECT DISTINCT doc_id, scan_id, "
       "file_path, line_no, unnest(regexp_extract_all(line, 'pkg_([0-9]+)[^0-9]', 1))::BIGINT AS k "
       "FROM lines) SELECT scan_id, file_path, concat('part-', p_partkey) AS rule_id, line_no AS "
       "line_start FROM named JOIN part ON k = p_partkey")
def _(spark, sf):
    table = views.table(spark, sf, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("rule_id"),
        F.concat(F.lit("pkg_"), "p_partkey", F.lit("[^0-9]")).alias("pattern"),
        F.lit("insecure_llm_call").alias("category"), F.lit("info").alias("severity"),
        F.lit("named package").alias("message"), F.lit(None).cast("string").alias("fix"),
    )
    found = rule_index.scan_rule_table(views.code(spark, sf), table)
    return found.select(*KEY, "rule_id", long("line_start"))


_IMPORT_RULE = (
    "CASE WHEN registry = 'npm' AND is_from AND regexp_matches(module, '^[a-zA-Z@][a-zA-Z0-9./_-]*$') "
    "THEN 'ai-hallucinated-npm-import' WHEN registry = 'pypi' AND is_from AND "
    "regexp_matches(module, '^[a-zA-Z_][a-zA-Z0-9_.]*$') THEN 'ai-hallucinated-import-from' "
    "WHEN registry = 'pypi' AND NOT is_from AND regexp_matches(module, '^[a-zA-Z_][a-zA-Z0-9_]*$') "
    "THEN 'ai-hallucinated-import' END"
)


@query("import_rule_findings", with_(*_IMPORTS) + " SELECT scan_id, file_path, rule_id, "
       "'medium' AS severity, line_no AS line_start FROM (SELECT *, "
       f"{_IMPORT_RULE} AS rule_id FROM imports) WHERE rule_id IS NOT NULL")
def _(spark, sf):
    found = structural.import_rule_findings(views.code(spark, sf))
    return found.select(*KEY, "rule_id", "severity", long("line_start"))


# The closing statement follows two imports and k blocks of six lines.
_TAIL_LINE = "3 + 6 * (doc_id % 3)"


def _tail(remainder: str, rule: str, severity: str, category: str, extra: int = 0) -> str:
    return (
        "SELECT source AS scan_id, concat(source, '/src/m', doc_id, '.py') AS file_path, "
        f"{q(rule)} AS rule_id, {q(severity)} AS severity, {q(category)} AS category, "
        f"{_TAIL_LINE} + {extra} AS line_start FROM documents WHERE doc_id % 7 = {remainder}"
    )


@query("python_rule_findings", " UNION ALL ".join([
    _tail("0", "eval-llm-output", "high", "unvalidated_ai_output"),
    _tail("1", "no-error-handling-openai", "medium", "missing_error_handling"),
    _tail("1", "insecure-llm-no-content-filter", "low", "insecure_llm_call"),
    _tail("3", "prompt-injection-fstring", "high", "prompt_injection"),
    _tail("4", "prompt-injection-format", "high", "prompt_injection"),
    _tail("5", "hardcoded-openai-key", "high", "hardcoded_secret"),
]))
def _(spark, sf):
    found = structural.python_rule_findings(views.modules(spark, sf))
    return found.select(*KEY, "rule_id", "severity", "category", long("line_start"))


@query("js_rule_findings", "SELECT source AS scan_id, concat(source, '/src/s', doc_id, '.ts') "
       "AS file_path, CASE WHEN doc_id % 4 = 0 THEN 'prompt-injection-concat-js' ELSE "
       "'prompt-injection-template-literal' END AS rule_id, 1::BIGINT AS line_start "
       "FROM documents WHERE doc_id % 4 IN (0, 1)")
def _(spark, sf):
    found = structural.js_rule_findings(views.scripts(spark, sf))
    return found.select(*KEY, "rule_id", long("line_start"))


_ENGINE = ("CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'WARNING' WHEN 'click' "
           "THEN 'info' ELSE event_type END")


@query("map_severity", f"SELECT event_id, {_ENGINE} AS given, CASE event_type WHEN 'error' "
       "THEN 'high' WHEN 'click' THEN 'low' ELSE 'medium' END AS severity FROM events")
def _(spark, sf):
    rows = views.table(spark, sf, "events").selectExpr("event_id", f"{_ENGINE} AS given")
    return rows.withColumn("severity", findings.map_severity(F.col("given")))


_RULE_NAMES = ["Prompt-x", "sql-injection", "hallucinated-pkg", "secret-in-log", "api-KEY",
               "llm-timeout", "main-thread", "unsafe-yaml"]
_NAME = ("CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_RULE_NAMES))
         + " END")


@query("categorize", f"SELECT doc_id, {_NAME} AS rule_id, CASE WHEN doc_id % 8 IN (0, 1) "
       "THEN 'prompt_injection' WHEN doc_id % 8 = 2 THEN 'hallucinated_dependency' "
       "WHEN doc_id % 8 IN (3, 4) THEN 'hardcoded_secret' WHEN doc_id % 8 IN (5, 6) "
       "THEN 'insecure_llm_call' ELSE 'unvalidated_ai_output' END AS category FROM documents")
def _(spark, sf):
    rows = views.table(spark, sf, "documents").selectExpr("doc_id", f"{_NAME} AS rule_id")
    return rows.withColumn("category", findings.categorize(F.col("rule_id")))


@query("complete_foreign", f"SELECT doc_id, {_NAME} AS rule_id, CASE WHEN doc_id % 2 = 0 "
       "THEN 'critical' ELSE 'high' END AS severity, CASE WHEN doc_id % 3 = 0 THEN "
       "'jailbreak_risk' WHEN doc_id % 8 IN (0, 1) THEN 'prompt_injection' WHEN doc_id % 8 = 2 "
       "THEN 'hallucinated_dependency' WHEN doc_id % 8 IN (3, 4) THEN 'hardcoded_secret' "
       "WHEN doc_id % 8 IN (5, 6) THEN 'insecure_llm_call' ELSE 'unvalidated_ai_output' END "
       "AS category FROM documents")
def _(spark, sf):
    rows = views.table(spark, sf, "documents").selectExpr(
        "doc_id", f"{_NAME} AS rule_id",
        "CASE WHEN doc_id % 2 = 0 THEN 'Critical' ELSE 'ERROR' END AS severity",
        "CASE WHEN doc_id % 3 = 0 THEN 'jailbreak_risk' END AS category",
    )
    return findings.complete_foreign(rows)


def _external(spark, sf):
    """Repeats of the critical line findings, as an outside engine reports them."""
    return _line_findings(spark, sf).where("severity = 'critical'").withColumn(
        "message", F.lit("outside")
    )


def _structural_copy(spark, sf):
    """The high findings once more, from a source that outranks the line rules."""
    return _line_findings(spark, sf).where("severity = 'high'").withColumn(
        "message", F.lit("structural")
    )


@query("union_findings", with_(*_FINDINGS) + " SELECT scan_id, rule_id, source_rank, count(*) "
       "AS n FROM (SELECT *, 1 AS source_rank FROM findings UNION ALL SELECT *, 2 FROM findings "
       "WHERE severity = 'critical') GROUP BY 1, 2, 3")
def _(spark, sf):
    merged = findings.union_findings(
        line=_line_findings(spark, sf), external=_external(spark, sf)
    )
    return merged.groupBy("scan_id", "rule_id", long("source_rank")).agg(F.count("*").alias("n"))


@query("dedup_findings", with_(*_FINDINGS) + " SELECT scan_id, file_path, line_start, rule_id, "
       "severity, CASE WHEN severity = 'high' THEN 'structural' ELSE message END AS message "
       "FROM findings")
def _(spark, sf):
    merged = findings.union_findings(
        external=_external(spark, sf),
        line=_line_findings(spark, sf),
        structural=_structural_copy(spark, sf),
    )
    return findings.dedup_findings(merged).select(
        *KEY, long("line_start"), "rule_id", "severity", "message"
    )


_COUNT_COLUMNS = ", ".join(f"{s}_count" for s in schemas.SEVERITIES)


@query("severity_counts", with_(*_FINDINGS, o.SEVERITY) + f" SELECT scan_id, {_COUNT_COLUMNS} "
       "FROM severity_counts")
def _(spark, sf):
    return findings.severity_counts(_line_findings(spark, sf))


@query("findings_score", with_(*_FINDINGS, o.SEVERITY, o.FINDING_SCORES) + " SELECT scan_id, "
       f"{_COUNT_COLUMNS}, findings_score FROM finding_scores")
def _(spark, sf):
    code = views.code(spark, sf)
    counts = findings.severity_counts(rules.scan_rules(code))
    return findings.findings_score(counts, code)


@query("review_candidates", with_(*o.CODE) + " SELECT scan_id, file_path, sha256(substr(content, "
       "1, 4000)) AS excerpt_hash FROM (SELECT *, row_number() OVER (PARTITION BY scan_id "
       "ORDER BY file_path) AS rn FROM files) WHERE rn <= 10 AND regexp_matches(lower(content), "
       "'openai|llm|prompt|gpt|anthropic|langchain')")
def _(spark, sf):
    rows = findings.review_candidates(views.code(spark, sf))
    return rows.select(*KEY, F.sha2(F.col("excerpt").cast("binary"), 256).alias("excerpt_hash"))


@query("parse_external_findings", f"WITH r AS (SELECT {views.select_list(views.REPLY_COLUMNS)} "
       "FROM documents WHERE doc_id % 4 = 0) SELECT scan_id, file_path, 'semantic.jailbreak_risk' "
       "AS rule_id, 'jailbreak_risk' AS category, 'low' AS severity, doc_id % 90 + 1 "
       "AS line_start, concat('m', doc_id) AS message, 'f' AS fix_suggestion FROM r UNION ALL "
       "SELECT scan_id, file_path, 'semantic.unknown', 'insecure_llm_call', 'medium', 2, '', NULL "
       "FROM r")
def _(spark, sf):
    rows = findings.parse_external_findings(views.replies(spark, sf))
    return rows.select(
        *KEY, "rule_id", "category", "severity", long("line_start"), "message", "fix_suggestion"
    )


# ---------------------------------------------------------------------------
# Watermarks
# ---------------------------------------------------------------------------

_MARKED = [*o.PLAIN, *o.WATERMARK]


@query("author_hash", with_(o.AUTHORS) + " SELECT author_id, salt, author_hash FROM authors")
def _(spark, sf):
    return watermark.author_hash(views.authors(spark, sf))


@query("payload_bits", with_(o.AUTHORS) + " SELECT author_id, " + " || ".join(
    f"lpad(bin(ascii(substr(author_hash, {k + 1}, 1))), 8, '0')" for k in range(8))
    + " AS bits FROM authors")
def _(spark, sf):
    return watermark.payload_bits(views.authors(spark, sf)).select("author_id", "bits")


@query("embed_watermark", with_(*o.PLAIN, o.AUTHORS, o.MARKED) + " SELECT scan_id, file_path, "
       "sha256(content) AS content_hash FROM marked")
def _(spark, sf):
    return views.marked(spark, sf).select(
        *KEY, F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")
    )


# Marks of the default 64 bits in every file, read back from where they were written.
@query("embed_codebase", with_(*o.PLAIN, "owned AS (SELECT *, sha256('author1:') AS author_hash FROM files)",
                               o.marked(watermark.DEFAULT_BITS))
       + " SELECT scan_id, file_path, sha256(content) AS text_hash, count(*) OVER (PARTITION BY scan_id) "
       "AS files_marked FROM marked")
def _(spark, sf):
    output = scratch_dir(spark, "marked")
    counts = watermark.embed_codebase(views.files(spark, sf), "author1", output)
    return spark.read.parquet(output).join(counts, "scan_id").select(
        *KEY, F.sha2(F.col("content").cast("binary"), 256).alias("text_hash"), "files_marked"
    )


@query("extract_watermark", with_(*o.PLAIN, o.AUTHORS, o.MARKED, o.EXTRACTED) + " SELECT scan_id, "
       "file_path, payload, payload_is_hex FROM extracted")
def _(spark, sf):
    return watermark.extract_watermark(views.marked(spark, sf), views.BITS)


def _verified(spark, sf):
    extracted = watermark.extract_watermark(views.marked(spark, sf), views.BITS)
    return watermark.verify_watermark(extracted, views.claims(spark, sf), views.BITS)


@query("verify_watermark", with_(*_MARKED) + " SELECT scan_id, file_path, is_watermarked, "
       "has_claim, verified, author_hash FROM verified")
def _(spark, sf):
    return _verified(spark, sf)


@query("watermark_confidence", with_(*_MARKED) + " SELECT scan_id, file_path, is_watermarked, "
       f"verified, {o.CONFIDENCE}::DOUBLE AS confidence FROM verified")
def _(spark, sf):
    rows = watermark.watermark_confidence(_verified(spark, sf))
    return rows.select(*KEY, "is_watermarked", "verified", "confidence")


@query("watermark_score", with_(*_MARKED, o.WATERMARK_SCORES) + " SELECT scan_id, total_files, "
       "watermarked_files, verified_files, round(watermark_score, 6) AS watermark_score "
       "FROM watermark_scores")
def _(spark, sf):
    rows = watermark.watermark_score(_verified(spark, sf))
    return rows.withColumn("watermark_score", F.round("watermark_score", 6))

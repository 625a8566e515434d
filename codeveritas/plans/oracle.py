"""Checking SQL: the registered queries restated for a plain SQL engine.

Every statement starts from the given tables and follows the definition of
the operator row by row (lines, words, characters exploded), so it shares no
logic with the array expressions it checks.
"""

from __future__ import annotations

from .. import schemas
from ..functions.text import WHITESPACE, WORD_RUN
from ..operators import dependencies, heuristics, rules, symbols
from . import views

LANGUAGE = (
    "CASE doc_id % 9 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' "
    "WHEN 3 THEN 'java' WHEN 4 THEN 'go' WHEN 5 THEN 'markdown' WHEN 6 THEN 'python' "
    "WHEN 7 THEN 'r' ELSE 'rust' END"
)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def qlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


SPACE = q(WHITESPACE)


def rx(pattern: str, *, ignore_case: bool = False, multiline: bool = False) -> str:
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    return q((f"(?{flags})" if flags else "") + pattern)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def base(columns: dict[str, str], name: str = "raw") -> str:
    return f"{name} AS (SELECT {views.select_list(columns)}, source FROM documents)"


# Every document is supported and small enough; language by extension.
PREPARED = (
    f"files AS (SELECT *, {LANGUAGE} AS language, strlen(content) AS size_bytes FROM raw "
    "WHERE strlen(content) <= 512000)"
)
PLAIN = [base(views.FILE_COLUMNS), PREPARED]
CODE = [base(views.CODE_COLUMNS), PREPARED]

LINES = (
    "lines AS (SELECT doc_id, scan_id, file_path, language, "
    "unnest(string_split(content, chr(10))) AS line, "
    "generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)"
)
SOLID = (
    f"solid AS (SELECT *, length(line) AS len, length(line) - length(ltrim(line, {SPACE})) "
    f"AS indent FROM lines WHERE rtrim(line, {SPACE}) <> '')"
)
# Every file, with its line counts and length statistics.
PROFILE = (
    "profile AS (SELECT f.doc_id, f.scan_id, f.file_path, f.language, l.line_count, "
    "l.line_count - coalesce(s.solid_lines, 0) AS blank_lines, "
    "coalesce(s.avg_len, 0) AS avg_line_length, coalesce(s.max_len, 0) AS max_line_length, "
    "coalesce(s.solid_lines, 0) AS solid_lines, coalesce(s.std_len, 0) AS std_len, "
    "coalesce(s.avg_indent, 0) AS avg_indent, coalesce(s.std_indent, 0) AS std_indent "
    "FROM files f JOIN (SELECT doc_id, count(*) AS line_count FROM lines GROUP BY 1) l "
    "USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS solid_lines, avg(len) AS avg_len, "
    "max(len) AS max_len, stddev_samp(len) AS std_len, avg(indent) AS avg_indent, "
    "stddev_samp(indent) AS std_indent FROM solid GROUP BY 1) s USING (doc_id))"
)
PYTHON = "language = 'python'"
JS = "language IN ('javascript', 'typescript')"


def hits(column: str, pattern: str, **flags: bool) -> str:
    return f"regexp_matches({column}, {rx(pattern, **flags)})"


def found(column: str, pattern: str, group: int = 0, **flags: bool) -> str:
    return f"regexp_extract_all({column}, {rx(pattern, **flags)}, {group})"


def counted(column: str, pattern: str, **flags: bool) -> str:
    return f"len({found(column, pattern, **flags)})"


# --- symbols ---------------------------------------------------------------

# Line-wise: the keyword's line, as each symbol starts on its own line.
PY_IMPORT_LINES = (
    "py_imports AS (SELECT doc_id, scan_id, file_path, language, 'pypi' AS registry, line_no, "
    f"regexp_extract(line, {rx(symbols.PY_IMPORT)}, 3) AS from_module, "
    f"regexp_extract(line, {rx(symbols.PY_IMPORT)}, 4) AS names FROM lines "
    f"WHERE {PYTHON} AND {hits('line', symbols.PY_IMPORT)})"
)
IMPORTS = (
    "imports AS (SELECT doc_id, scan_id, file_path, language, registry, from_module AS module, "
    "line_no, true AS is_from FROM py_imports WHERE from_module <> '' UNION ALL "
    "SELECT doc_id, scan_id, file_path, language, registry, module, line_no, false FROM ("
    "SELECT *, trim(string_split(trim(unnest(string_split(names, ','))), ' as ')[1]) AS module "
    "FROM py_imports WHERE from_module = '') WHERE module <> '' UNION ALL "
    "SELECT doc_id, scan_id, file_path, language, 'npm', "
    f"regexp_extract(line, {rx(symbols.JS_IMPORT)}, 3), line_no, regexp_matches("
    f"regexp_extract(line, {rx(symbols.JS_IMPORT)}, 2), {rx(symbols.JS_DEFAULT)}) FROM lines "
    f"WHERE {JS} AND {hits('line', symbols.JS_IMPORT)})"
)
SYMBOL_COUNTS = (
    "symbol_counts AS (SELECT doc_id, "
    f"CASE WHEN {PYTHON} THEN {counted('content', symbols.PY_FUNCTION, multiline=True)} "
    f"WHEN {JS} THEN {counted('content', symbols.JS_FUNCTION)} ELSE 0 END AS function_count, "
    f"CASE WHEN {PYTHON} THEN {counted('content', symbols.PY_CLASS, multiline=True)} "
    f"WHEN {JS} THEN {counted('content', symbols.JS_CLASS, multiline=True)} ELSE 0 END "
    "AS class_count, "
    f"({PYTHON}) AND {hits('content', symbols.PY_TYPE_HINT)} AS has_type_hints FROM files)"
)
COMMENTS = (
    "comments AS (SELECT doc_id, count(*) FILTER (WHERE "
    f"({PYTHON} AND {hits('line', symbols.PY_COMMENT_LINE)}) OR "
    f"({JS} AND {hits('line', symbols.JS_COMMENT_LINE)})) AS comment_lines FROM lines GROUP BY 1)"
)

# --- heuristic signals -------------------------------------------------------

D_LINES = (
    "line_hits AS (SELECT doc_id, "
    f"count(*) FILTER (WHERE {hits('line', heuristics.DIVIDER)}) AS dividers, "
    f"count(*) FILTER (WHERE {hits('line', heuristics.STEP, ignore_case=True)}) AS steps, "
    f"count(*) FILTER (WHERE {hits('line', heuristics.COMMENT_START)}) AS comments, "
    f"count(*) FILTER (WHERE {hits('line', heuristics.DESCRIPTIVE, ignore_case=True)}) "
    "AS described FROM lines GROUP BY 1)"
)
WORDS = (
    f"words AS (SELECT doc_id, unnest({found('content', WORD_RUN)}) AS w, "
    f"generate_subscripts({found('content', WORD_RUN)}, 1) AS pos FROM files)"
)
IDENTIFIERS = (
    "ids AS (SELECT doc_id, count(*) AS n, avg(length(w)) AS avg_len, "
    "avg(CASE WHEN length(w) <= 2 THEN 1.0 ELSE 0.0 END) AS short, "
    "avg(CASE WHEN contains(w, '_') AND w = lower(w) THEN 1.0 ELSE 0.0 END) AS snake, "
    f"avg(CASE WHEN {hits('w', heuristics.CAMEL)} THEN 1.0 ELSE 0.0 END) AS camel FROM words "
    f"WHERE {hits('w', heuristics.IDENTIFIER)} AND w NOT IN {qlist(heuristics.COMMON_KEYWORDS)} "
    "GROUP BY 1)"
)
WORD_STATS = (
    "word_stats AS (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS n_distinct "
    "FROM words GROUP BY 1)"
)
BIGRAMS = (
    "pairs AS (SELECT a.doc_id, a.w AS w1, b.w AS w2, count(*) AS n FROM words a JOIN words b "
    "ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY 1, 2, 3), "
    "bigrams AS (SELECT doc_id, sum(n) AS n, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS repeated "
    "FROM pairs GROUP BY 1)"
)
ENTROPY = (
    "char_counts AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, "
    "unnest(string_split(content, '')) AS c FROM files) WHERE c <> '' GROUP BY 1, 2), "
    "entropy AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h "
    "FROM char_counts GROUP BY 1)"
)
BLANKS = (
    "gap_rows AS (SELECT doc_id, line_no - lag(line_no) OVER (PARTITION BY doc_id "
    f"ORDER BY line_no) AS gap FROM lines WHERE rtrim(line, {SPACE}) = ''), "
    "gaps AS (SELECT doc_id, count(*) AS blanks, coalesce(stddev_samp(gap), 0) AS gap_std "
    "FROM gap_rows GROUP BY 1)"
)


def ladder(value: str, bounds: list[tuple[float, float]], otherwise: float, op: str) -> str:
    body = " ".join(f"WHEN {value} {op} {b} THEN {s}" for b, s in bounds)
    return f"CASE {body} ELSE {otherwise} END"


_BOILER = " + ".join(
    f"CASE WHEN {hits('content', p, ignore_case=True)} THEN 1 ELSE 0 END"
    for p in heuristics.BOILERPLATE
)
# The annotation's right edge is consumed here; it is only looked at there.
_ANNOTATION = heuristics.TYPE_ANNOTATION.replace("(?!", "(?:[^", 1)
_ANNOTATION = _ANNOTATION[: _ANNOTATION.rindex("(?:[^")] + r"(?:[^\p{L}\p{N}_]|\z)"


def _occurrences(literal: str) -> str:
    return (
        f"((length(content) - length(replace(content, {q(literal)}, ''))) // {len(literal)})"
    )


SIGNALS = (
    "parts AS (SELECT p.*, f.content, h.dividers, h.steps, h.comments, h.described, "
    "h.comments / p.line_count AS share, coalesce(i.n, 0) AS id_n, i.avg_len AS id_len, i.short, "
    "greatest(i.snake, i.camel) AS convention, coalesce(w.n, 0) AS word_n, w.n_distinct, "
    "coalesce(b.n, 0) AS pair_n, coalesce(b.repeated, 0) AS repeated, "
    "coalesce(e.h, 0) AS h, coalesce(g.blanks, 0) AS blanks, g.gap_std, "
    f"({_BOILER}) / {len(heuristics.BOILERPLATE)} AS boiler, "
    f"(({_occurrences(chr(34) * 3)} + {_occurrences(chr(39) * 3)}) // 2 + {_occurrences('/**')}) "
    f"/ greatest({counted('content', heuristics.FUNCTION_HINT)}, 1) AS doc_ratio, "
    f"{counted('content', _ANNOTATION)} / p.line_count AS hint_ratio "
    "FROM profile p JOIN files f USING (doc_id) JOIN line_hits h USING (doc_id) "
    "LEFT JOIN ids i USING (doc_id) LEFT JOIN word_stats w USING (doc_id) "
    "LEFT JOIN bigrams b USING (doc_id) LEFT JOIN entropy e USING (doc_id) "
    "LEFT JOIN gaps g USING (doc_id)), "
    "signals AS (SELECT doc_id, scan_id, file_path, language, line_count, content, "
    "CASE WHEN solid_lines < 5 OR avg_line_length = 0 THEN 0.5 ELSE "
    + ladder(
        "std_len / avg_line_length",
        [(0.25, 0.85), (0.40, 0.65), (0.55, 0.45), (0.70, 0.30)], 0.15, "<",
    )
    + " END AS line_length_uniformity, "
    "CASE WHEN dividers = 0 AND steps < 2 AND NOT (share > 0.12 AND share <> 0.35) "
    "AND described < 3 THEN 0.3 ELSE least(1.0, ("
    "CASE WHEN dividers > 0 THEN least(1.0, dividers / greatest(line_count * 0.02, 1)) * 0.8 "
    "ELSE 0 END + CASE WHEN steps >= 2 THEN 0.7 ELSE 0 END + "
    "CASE WHEN share > 0.12 AND share < 0.35 THEN 0.5 WHEN share > 0.35 THEN 0.3 ELSE 0 END + "
    "CASE WHEN described >= 3 THEN least(1.0, described / 5) * 0.6 ELSE 0 END) / ("
    "(dividers > 0)::INT + (steps >= 2)::INT + (share > 0.12 AND share <> 0.35)::INT + "
    "(described >= 3)::INT)) END AS comment_pattern, "
    "CASE WHEN id_n < 10 THEN 0.5 ELSE least(1.0, ("
    + ladder("id_len", [(10, 0.7), (7, 0.5), (5, 0.3)], 0, ">") + " + "
    + ladder("short", [(0.05, 0.6), (0.15, 0.3)], 0, "<") + " + "
    + ladder("convention", [(0.6, 0.5), (0.4, 0.3)], 0, ">")
    + ") / 1.8) END AS naming_regularity, "
    "CASE WHEN length(content) < 100 OR word_n = 0 THEN 0.5 ELSE least(1.0, ("
    + ladder("n_distinct / word_n", [(0.30, 0.7), (0.45, 0.5), (0.55, 0.3)], 0, "<") + " + "
    + ladder(
        "repeated / greatest(pair_n, 1)", [(0.5, 0.6), (0.3, 0.4), (0.15, 0.2)], 0, ">"
    )
    + " + CASE WHEN h > 3.5 AND h < 5.0 THEN 0.3 ELSE 0 END) / 1.6) END AS entropy_signal, "
    "CASE WHEN line_count < 10 OR solid_lines < 5 THEN 0.5 ELSE least(1.0, "
    + ladder(
        "(CASE WHEN blanks >= 3 THEN 1.0 / (1.0 + gap_std) ELSE 0.5 END)",
        [(0.3, 0.5), (0.15, 0.3)], 0, ">",
    )
    + " + CASE WHEN std_indent < 3 AND avg_indent > 1 THEN 0.5 WHEN std_indent < 5 THEN 0.3 "
    "ELSE 0 END) END AS structural_regularity, "
    + ladder("boiler", [(0.5, 0.7), (0.3, 0.5), (0.15, 0.35)], 0.2, ">")
    + " AS boilerplate_ratio, least(1.0, ("
    + ladder("doc_ratio", [(0.8, 0.7), (0.4, 0.4)], 0, ">") + " + "
    + ladder("hint_ratio", [(0.05, 0.5), (0.02, 0.3)], 0, ">")
    + ") / 1.2) AS docstring_density FROM parts)"
)
_MIX = " + ".join(f"{name} * {weight}" for name, weight in heuristics.SIGNAL_WEIGHTS.items())
BLANK = f"rtrim(content, {SPACE}) = ''"
SCORED = (
    f"scored AS (SELECT *, CASE WHEN {BLANK} THEN 0.5 ELSE greatest(0.0, least(1.0, {_MIX})) END "
    "AS heuristic FROM signals)"
)
HEURISTIC = [
    LINES, SOLID, PROFILE, D_LINES, WORDS, IDENTIFIERS, WORD_STATS, BIGRAMS, ENTROPY, BLANKS,
    SIGNALS, SCORED,
]

# --- dependencies --------------------------------------------------------------

REGISTRY = (
    "registry AS (SELECT r.registry, concat('pkg_', p_partkey) AS package FROM part, "
    "(SELECT 'pypi' AS registry UNION ALL SELECT 'npm') r WHERE p_partkey % 3 <> 0)"
)
CHECKABLE = (
    "rooted AS (SELECT *, CASE WHEN registry = 'pypi' THEN string_split(module, '.')[1] "
    "ELSE module END AS package FROM imports), "
    "checkable AS (SELECT * FROM rooted WHERE NOT (registry = 'pypi' AND package IN "
    f"{qlist(dependencies.PYTHON_STDLIB)}) AND NOT (registry = 'npm' AND "
    "(module LIKE '.%' OR module LIKE '/%')))"
)
UNKNOWN = (
    "unknown AS (SELECT c.* FROM checkable c WHERE c.registry IN (SELECT registry FROM registry) "
    "AND NOT EXISTS (SELECT 1 FROM registry r WHERE r.registry = c.registry "
    "AND r.package = c.package))"
)
DEPS = [PY_IMPORT_LINES, IMPORTS, REGISTRY, CHECKABLE, UNKNOWN]

# --- findings --------------------------------------------------------------------


def _rule_rows(rule: dict, source: str) -> str:
    fix = "NULL" if rule.get("fix") is None else q(rule["fix"])
    return (
        f"SELECT doc_id, scan_id, file_path, {q(rule['rule_id'])} AS rule_id, "
        f"{q(rule['category'])} AS category, {q(rule['severity'])} AS severity, "
        f"line_no AS line_start, {q(rule['message'])} AS message, "
        f"substr(trim(line, {SPACE}), 1, 200) AS snippet, {fix} AS fix_suggestion "
        f"FROM {source} WHERE {hits('line', rule['pattern'], ignore_case=True)}"
    )


FINDINGS = (
    "findings AS (" + " UNION ALL ".join(_rule_rows(r, "lines") for r in rules.LINE_RULES) + ")"
)
_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}_count" for s in schemas.SEVERITIES
)
SEVERITY = f"severity_counts AS (SELECT scan_id, {_COUNTS} FROM findings GROUP BY 1)"
_PENALTY = " + ".join(
    f"coalesce({s}_count, 0) * {p}" for s, p in schemas.SEVERITY_PENALTY.items()
)
FINDING_SCORES = (
    "finding_scores AS (SELECT s.scan_id, "
    + ", ".join(f"coalesce({s}_count, 0) AS {s}_count" for s in schemas.SEVERITIES)
    + f", greatest(0.0, 100.0 - ({_PENALTY})) AS findings_score "
    "FROM (SELECT DISTINCT scan_id FROM files) s LEFT JOIN severity_counts c USING (scan_id))"
)

# --- watermark ---------------------------------------------------------------------

N = views.BITS
AUTHORS = (
    "authors AS (SELECT concat('author', s_suppkey) AS author_id, concat('s', s_suppkey % 3) "
    "AS salt, sha256(concat('author', s_suppkey, ':s', s_suppkey % 3)) AS author_hash "
    "FROM supplier)"
)


def marked(n: int) -> str:
    """`marked`: the files of `owned` (author_hash, null for none) with marks of n bits."""
    bits = "".join(
        f" || lpad(bin(ascii(substr(author_hash, {k + 1}, 1))), 8, '0')" for k in range(n // 8)
    )[4:]
    return (
        "owned_lines AS (SELECT *, unnest(string_split(content, chr(10))) AS line, "
        "generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM owned), "
        f"carriers AS (SELECT *, CASE WHEN rtrim(line, {SPACE}) <> '' THEN sum(CASE WHEN "
        f"rtrim(line, {SPACE}) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) "
        "END AS k FROM owned_lines), "
        "marked_lines AS (SELECT *, CASE WHEN author_hash IS NULL THEN line ELSE "
        f"concat(rtrim(line, {SPACE}), CASE WHEN k <= {n} THEN CASE WHEN substr({bits}, k::INT, 1) "
        "= '0' THEN ' ' ELSE chr(9) END ELSE '' END) END AS marked_line FROM carriers), "
        "marked AS (SELECT doc_id, scan_id, file_path, language, "
        "string_agg(marked_line, chr(10) ORDER BY line_no) AS content FROM marked_lines "
        "GROUP BY 1, 2, 3, 4)"
    )


MARKED = (
    "owned AS (SELECT f.*, a.author_hash FROM files f LEFT JOIN authors a ON a.author_id = "
    "CASE WHEN doc_id % 3 <> 0 THEN concat('author', doc_id % 4) END), " + marked(N)
)
EXTRACTED = (
    "mark_lines AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, "
    "generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM marked), "
    f"tails AS (SELECT doc_id, line_no, substr(line, length(rtrim(line, {SPACE})) + 1, 1) AS t "
    f"FROM mark_lines WHERE rtrim(line, {SPACE}) <> ''), "
    "bits AS (SELECT doc_id, CASE WHEN t = ' ' THEN 0 ELSE 1 END AS bit, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM tails "
    "WHERE t IN (' ', chr(9))), "
    "octets AS (SELECT doc_id, (k - 1) // 8 AS o, sum(bit * (1 << (7 - (k - 1) % 8)::INT)) AS v, "
    f"count(*) AS n FROM bits WHERE k <= {N} GROUP BY 1, 2), "
    "payloads AS (SELECT doc_id, string_agg(chr(v::INT), '' ORDER BY o) AS payload FROM octets "
    f"GROUP BY 1 HAVING sum(n) = {N}), "
    "extracted AS (SELECT m.scan_id, m.file_path, p.payload, coalesce(regexp_matches(p.payload, "
    "'^[0-9a-f]+$'), false) AS payload_is_hex FROM marked m LEFT JOIN payloads p USING (doc_id))"
)
CLAIMS = (
    "claims AS (SELECT s.scan_id, a.author_hash, substr(a.author_hash, 1, 2) AS payload "
    "FROM (SELECT DISTINCT source AS scan_id FROM documents) s, authors a WHERE "
    "regexp_extract(s.scan_id, '([0-9]+)$', 1)::INT % 2 = 0 AND a.author_id IN "
    "('author0', 'author1'))"
)
VERIFIED = (
    "verified AS (SELECT scan_id, file_path, payload IS NOT NULL AS is_watermarked, "
    "scan_id IN (SELECT scan_id FROM claims) AS has_claim, "
    "CASE WHEN payload IS NOT NULL AND scan_id IN (SELECT scan_id FROM claims) THEN "
    "(SELECT count(*) FROM claims c WHERE c.scan_id = e.scan_id AND c.payload = e.payload) > 0 "
    "END AS verified, substr((SELECT min(author_hash) FROM claims c WHERE c.scan_id = e.scan_id "
    "AND c.payload = e.payload), 1, 16) AS author_hash FROM extracted e)"
)
CONFIDENCE = (
    "CASE WHEN NOT is_watermarked THEN 0.0 WHEN verified IS NULL THEN 0.7 WHEN verified THEN 1.0 "
    "ELSE 0.3 END"
)
WATERMARK = [AUTHORS, MARKED, EXTRACTED, CLAIMS, VERIFIED]
WATERMARK_SCORES = (
    "watermark_scores AS (SELECT scan_id, count(*) AS total_files, "
    "count(*) FILTER (WHERE is_watermarked) AS watermarked_files, "
    "count(*) FILTER (WHERE verified) AS verified_files, "
    "CASE WHEN bool_or(has_claim) THEN count(*) FILTER (WHERE verified) ELSE "
    "count(*) FILTER (WHERE is_watermarked) END / count(*) * 100.0 AS watermark_score "
    "FROM verified GROUP BY 1)"
)

# --- scores --------------------------------------------------------------------------

AUTHORSHIP = (
    "authorship AS (SELECT s.scan_id, s.file_path, s.language, s.line_count, c.function_count, "
    "coalesce(u.n, 0) AS unknown_imports, CASE WHEN " + BLANK + " THEN 'skipped' "
    "WHEN s.language = 'python' THEN 'ml_default' ELSE 'heuristic' END AS detection_method, "
    "least(1.0, CASE WHEN " + BLANK + " THEN 0.0 WHEN s.language = 'python' THEN 0.5 "
    "ELSE s.heuristic END + 0.10 * coalesce(u.n, 0)) AS ai_probability FROM scored s "
    "JOIN symbol_counts c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM unknown "
    "GROUP BY 1) u USING (doc_id))"
)
AUTHORSHIP_SCORES = (
    "authorship_scores AS (SELECT scan_id, count(*) AS total_files, avg(ai_probability) "
    "AS overall_ai_probability, count(*) FILTER (WHERE ai_probability > 0.6) "
    "AS style_anomaly_count, greatest(0.0, 100.0 * (1.0 - avg(ai_probability))) "
    "AS authorship_score, sum(line_count)::BIGINT AS total_lines, "
    "string_agg(DISTINCT language, ',' ORDER BY language) AS languages "
    "FROM authorship GROUP BY 1)"
)
PILLARS = [*HEURISTIC, SYMBOL_COUNTS, *DEPS, AUTHORSHIP, AUTHORSHIP_SCORES, FINDINGS, SEVERITY,
           FINDING_SCORES]
# The code view carries no marks, so its watermark score is 0 everywhere.
TRUST = (
    "trust AS (SELECT a.scan_id, authorship_score, findings_score, 0.0 AS watermark_score, "
    "round(greatest(0.0, least(100.0, authorship_score * 0.35 + findings_score * 0.40)), 2) "
    "AS trust_score FROM authorship_scores a JOIN finding_scores f USING (scan_id))"
)

# --- events ----------------------------------------------------------------------------

EVENTS = f"scan_events AS (SELECT {views.select_list(views.EVENT_COLUMNS)} FROM events)"

"""Line rules: the built-in rule set and the scan that applies it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import arrays, text
from ..functions.text import WS
from .symbols import KEY

# ---------------------------------------------------------------------------
# Rule ids, patterns, categories and severities.  ``any_of`` are
# literals of which a matching text must contain one; it only saves work.
# ---------------------------------------------------------------------------

LINE_RULES = [
    {
        "rule_id": "prompt-injection-concat",
        "any_of": ["user", "input", "query", "prompt", "message"],
        "pattern": r"(?:f['\"]|\.format\(|%[" + WS + r"]*\().*(?:user|input|query|prompt|message)",
        "category": "prompt_injection",
        "severity": "high",
        "message": "Outside input is joined into a prompt string.",
        "fix": "Fill a fixed template and escape the input first.",
    },
    {
        "rule_id": "hardcoded-api-key",
        "any_of": ["key", "secret", "token", "password"],
        "pattern": (
            r"(?:api[_-]?key|secret|token|password)[" + WS + r"]*[=:][" + WS + r"]*"
            r"['\"][A-Za-z0-9+/=_-]{20,}['\"]"
        ),
        "category": "hardcoded_secret",
        "severity": "critical",
        "message": "A credential is written in the source.",
        "fix": "Load it from the environment or a vault.",
    },
    {
        "rule_id": "unvalidated-llm-response",
        "any_of": [".execute", "eval", "exec"],
        "pattern": (
            r"(?:\.execute|eval|exec)[" + WS + r"]*\([" + WS + r"]*"
            r"(?:response|result|output|completion)"
        ),
        "category": "unvalidated_ai_output",
        "severity": "critical",
        "message": "Model output is executed as it came.",
        "fix": "Parse and check the output; do not execute it.",
    },
    {
        "rule_id": "missing-llm-error-handling",
        "any_of": ["openai", "anthropic", "azure"],
        "pattern": r"(?:openai|anthropic|azure).*(?:create|complete|chat)[" + WS + r"]*\(",
        "category": "missing_error_handling",
        "severity": "medium",
        "message": "A remote model call shows no error handling.",
        "fix": "Catch failures, retry and set a timeout.",
    },
    {
        "rule_id": "insecure-llm-temperature",
        "any_of": ["temperature"],
        "pattern": r"temperature[" + WS + r"]*[=:][" + WS + r"]*(?:1\.0|1|2)",
        "category": "insecure_llm_call",
        "severity": "low",
        "message": "The sampling temperature is high.",
        "fix": "Choose a temperature of at most 0.3.",
    },
]

MAX_SNIPPET = 200
FINDING_ARRAY = f"array<{schemas.FINDING.simpleString()}>"


def finding(rule: dict, line_no: Column, snippet: Column) -> Column:
    return F.struct(
        F.lit(rule["rule_id"]).alias("rule_id"),
        F.lit(rule["category"]).alias("category"),
        F.lit(rule["severity"]).alias("severity"),
        line_no.cast("int").alias("line_start"),
        line_no.cast("int").alias("line_end"),
        F.lit(rule["message"]).alias("message"),
        F.substring(text.strip(snippet), 1, MAX_SNIPPET).alias("snippet"),
        F.lit(rule.get("fix")).cast("string").alias("fix_suggestion"),
    )


def hits(content: Column, pattern: str) -> Column:
    return text.matches(content, pattern, ignore_case=True)


def finding_array(content: Column, rules: list[dict] = LINE_RULES) -> Column:
    """Findings of one text as an array, in line order.

    A line that matches makes its whole text match, so a text without any
    match is settled by a literal search, or one pattern search, per rule and
    its lines are never split.
    """
    return _built(content, repr(rules)) if rules is LINE_RULES else _findings(content, rules)


@arrays.built_once
def _built(content: Column, _rules_key: str) -> Column:
    return _findings(content, LINE_RULES)


def _findings(content: Column, rules: list[dict]) -> Column:
    names = [f"r{k}" for k in range(len(rules))]

    def in_text(folded: Column) -> Column:
        tests = []
        for name, r in zip(names, rules, strict=True):
            test = hits(content, r["pattern"])
            literals = r.get("any_of")
            test = text.contains_any(folded, literals) & test if literals else test
            tests.append(test.alias(name))
        return F.struct(*tests)

    def in_lines(present: Column) -> Column:
        # Only the rules that match the text are tried on its lines.
        def of_line(line: Column, i: Column) -> Column:
            made = [
                F.when(present[name] & hits(line, r["pattern"]), finding(r, i + 1, line))
                for name, r in zip(names, rules, strict=True)
            ]
            return F.filter(F.array(*made), lambda f: f.isNotNull())

        found = F.flatten(F.transform(text.lines_of(content), of_line))
        return F.when(reduce(or_, [present[name] for name in names]), found)

    found = arrays.let(arrays.let(text.fold_case(content), in_text), in_lines)
    return F.coalesce(found.cast(FINDING_ARRAY), F.array().cast(FINDING_ARRAY))


def scan_rules(files: DataFrame, rules: list[dict] = LINE_RULES) -> DataFrame:
    """One row per (line, rule) match of the whole text."""
    return files.select(*KEY, F.inline(finding_array(F.col("content"), rules)))


def rules_from_table(table: DataFrame, max_rules: int = 1000) -> list[dict]:
    """A user's rule table as literals for ``scan_rules``.

    A rule set is configuration, so its size is checked and it is compiled
    into the scan's projection; joining lines with rules would emit every pair.
    """
    columns = ["rule_id", "pattern", "category", "severity", "message", "fix"]
    rows = table.select(*columns).limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules; split the table and union the scans")
    return [row.asDict() for row in rows]


def rule_hit_counts(files: DataFrame, rules: list[dict] = LINE_RULES) -> DataFrame:
    """Matching lines per scan and rule."""
    return scan_rules(files, rules).groupBy("scan_id", "rule_id").agg(
        F.count("*").alias("matches")
    )

"""Structural rules over Python syntax nodes and JavaScript tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text
from . import rules, scripts, syntax
from .findings import imports_as_findings, map_severity
from .symbols import KEY, is_js, is_python, js_imports, python_imports

# ---------------------------------------------------------------------------
# Rule ids, severities, categories and the words they look for
# ---------------------------------------------------------------------------

OUTPUT_WORDS = "response|result|output|completion|content|text|message"
INPUT_WORDS_PY = "user|input|query|request|message|prompt|data"
INPUT_WORDS_CONCAT = "user|input|query|req|body|params"
INPUT_WORDS_TEMPLATE = "user|input|query|req|body|params|message"

PYTHON_RULES = {
    "hardcoded-openai-key": ("ERROR", "hardcoded_secret", "An API key literal is assigned."),
    "eval-llm-output": ("ERROR", "unvalidated_ai_output", "Model output reaches eval or exec."),
    "no-error-handling-openai": (
        "WARNING", "missing_error_handling", "A completion call is outside any try block.",
    ),
    "insecure-llm-no-content-filter": (
        "INFO", "insecure_llm_call", "A completion call sets its temperature.",
    ),
    "prompt-injection-fstring": (
        "ERROR", "prompt_injection", "An f-string interpolates outside input.",
    ),
    "prompt-injection-format": (
        "ERROR", "prompt_injection", "A string literal is filled by format().",
    ),
}

JS_RULES = {
    "prompt-injection-concat-js": {
        "rule_id": "prompt-injection-concat-js",
        "category": "prompt_injection",
        "severity": "high",
        "message": "Outside input is concatenated.",
        "words": INPUT_WORDS_CONCAT,
        "kind": "punct",
        "text": "+",
    },
    "prompt-injection-template-literal": {
        "rule_id": "prompt-injection-template-literal",
        "category": "prompt_injection",
        "severity": "high",
        "message": "Outside input is part of a template literal.",
        "words": INPUT_WORDS_TEMPLATE,
        "kind": "template",
        "text": "`",
    },
}


def _subtree(nodes: Column, node: Column) -> Column:
    """The node and all below it, which follow it in pre-order."""
    return F.slice(nodes, node["id"] + 1, node["last"] - node["id"] + 1)


def _child(nodes: Column, node: Column, role: str, idx: int = 0) -> Column:
    """The direct child in a given role; it is one of the ids of the subtree."""
    return F.get(
        F.filter(
            _subtree(nodes, node),
            lambda c: (c["parent"] == node["id"]) & (c["role"] == role) & (c["idx"] == idx),
        ),
        F.lit(0),
    )


def _attribute_chain(nodes: Column, call: Column, names: list[str]) -> Column:
    """The callee of ``call`` is ``<anything>.names[0].names[1]...``.

    In pre-order the chain is the nodes right after the call, outermost
    attribute first.
    """
    checks = []
    for k, name in enumerate(reversed(names)):
        node = F.get(nodes, call["id"] + 1 + k)
        checks.append((node["type"] == "Attribute") & (node["name"] == name))
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def _is_completion(nodes: Column, node: Column) -> Column:
    return (node["type"] == "Call") & _attribute_chain(
        nodes, node, ["chat", "completions", "create"]
    )


def _hit_hardcoded_key(nodes: Column, code: Column, node: Column) -> Column:
    """``openai.api_key = "..."`` or ``x = openai.OpenAI(api_key="...")``."""
    target = _child(nodes, node, "targets")
    value = _child(nodes, node, "value")
    owner = F.get(nodes, target["id"] + 1)
    assigned = (
        (target["type"] == "Attribute") & (target["name"] == "api_key")
        & (owner["type"] == "Name") & (owner["name"] == "openai")
        & (value["type"] == "Constant") & (value["name"] == "str")
    )
    callee = F.get(nodes, value["id"] + 1)
    callee_owner = F.get(nodes, value["id"] + 2)
    keyword = _child(nodes, value, "keywords")
    literal = F.get(nodes, keyword["id"] + 1)
    built = (
        (value["type"] == "Call") & (callee["type"] == "Attribute")
        & (callee["name"] == "OpenAI") & (callee_owner["type"] == "Name")
        & (callee_owner["name"] == "openai") & (keyword["name"] == "api_key")
        & (literal["type"] == "Constant") & (literal["name"] == "str")
    )
    return F.when(node["type"] == "Assign", F.coalesce(assigned, F.lit(False)) |
                  F.coalesce(built, F.lit(False)))


def _hit_eval(nodes: Column, code: Column, node: Column) -> Column:
    callee = F.get(nodes, node["id"] + 1)
    named = (
        (node["type"] == "Call") & (node["n"] == 1) & (callee["type"] == "Name")
        & callee["name"].isin("eval", "exec")
    )
    argument = syntax.source_of(code, _child(nodes, node, "args"))
    return F.when(named, text.matches(argument, OUTPUT_WORDS))


def _inside_try(node: Column) -> Column:
    return F.exists(
        F.col("tries"), lambda t: (t["id"] < node["id"]) & (node["last"] <= t["last"])
    )


def _hit_unguarded(nodes: Column, code: Column, node: Column) -> Column:
    parent = F.get(nodes, node["parent"])
    assigned = (node["role"] == "value") & (parent["type"] == "Assign")
    return F.when(assigned & _is_completion(nodes, node), ~_inside_try(node))


def _hit_temperature(nodes: Column, code: Column, node: Column) -> Column:
    def is_temperature(k: Column) -> Column:
        return (
            (k["parent"] == node["id"]) & (k["type"] == "keyword") & (k["name"] == "temperature")
        )

    return F.when(_is_completion(nodes, node), F.exists(_subtree(nodes, node), is_temperature))


def _hit_fstring(nodes: Column, code: Column, node: Column) -> Column:
    def interpolates(v: Column) -> Column:
        inside = (v["type"] == "FormattedValue") & (v["parent"] == node["id"])
        expression = syntax.source_of(code, F.get(nodes, v["id"] + 1))
        return F.when(inside, text.matches(expression, INPUT_WORDS_PY)).otherwise(F.lit(False))

    return F.when(node["type"] == "JoinedStr", F.exists(_subtree(nodes, node), interpolates))


def _hit_format(nodes: Column, code: Column, node: Column) -> Column:
    callee = F.get(nodes, node["id"] + 1)
    literal = F.get(nodes, node["id"] + 2)
    return F.when(
        (node["type"] == "Call") & (node["n"] > 0),
        (callee["type"] == "Attribute") & (callee["name"] == "format")
        & (literal["type"] == "Constant") & (literal["name"] == "str"),
    )


_PREDICATES = {
    "hardcoded-openai-key": _hit_hardcoded_key,
    "eval-llm-output": _hit_eval,
    "no-error-handling-openai": _hit_unguarded,
    "insecure-llm-no-content-filter": _hit_temperature,
    "prompt-injection-fstring": _hit_fstring,
    "prompt-injection-format": _hit_format,
}

# A file without any of these words cannot match a Python rule, so it is
# neither parsed nor shipped to a Python worker.
_PYTHON_TRIGGER = r"api_key|eval|exec|completions|\bformat\b|[fF][rR]?['\"]|[rR][fF]['\"]"


def may_match_python() -> Column:
    return is_python() & F.rlike("code", F.lit(_PYTHON_TRIGGER))


def try_nodes(nodes: Column) -> Column:
    """Calls are compared with the try blocks of their file, not with all of its nodes."""
    return F.filter(nodes, lambda x: x["type"].isin("Try", "TryStar"))


def python_finding_array() -> Column:
    """Findings of one file from its columns code, nodes and tries (``try_nodes``)."""
    nodes, code = F.col("nodes"), F.col("code")

    def of_node(node: Column) -> Column:
        made = []
        for rule_id, hit in _PREDICATES.items():
            severity, category, message = PYTHON_RULES[rule_id]
            made.append(
                F.when(
                    hit(nodes, code, node),
                    F.struct(
                        F.lit(rule_id).alias("rule_id"),
                        F.lit(category).alias("category"),
                        map_severity(F.lit(severity)).alias("severity"),
                        node["line"].alias("line_start"),
                        node["line"].alias("line_end"),
                        F.lit(message).alias("message"),
                        F.substring(
                            text.strip(syntax.source_of(code, node)), 1, rules.MAX_SNIPPET
                        ).alias("snippet"),
                        F.lit(None).cast("string").alias("fix_suggestion"),
                    ),
                )
            )
        return F.filter(F.array(*made), lambda f: f.isNotNull())

    interesting = F.filter(nodes, lambda x: x["type"].isin("Assign", "Call", "JoinedStr"))
    return F.flatten(F.transform(interesting, of_node)).cast(rules.FINDING_ARRAY)


def python_rule_findings(files: DataFrame) -> DataFrame:
    """Findings of the Python structural rules."""
    return (
        files.where(may_match_python())
        .withColumn("nodes", syntax.python_nodes("code"))
        .withColumn("tries", try_nodes(F.col("nodes")))
        .select(*KEY, F.inline(python_finding_array()))
    )


def may_match_js() -> Column:
    content = F.col("content")
    words = F.rlike(content, F.lit(f"{INPUT_WORDS_CONCAT}|{INPUT_WORDS_TEMPLATE}"))
    return is_js() & (content.contains("+") | content.contains("`")) & words


def js_finding_array() -> Column:
    """Findings of one script from its columns content and tokens.

    A rule fires at a plus whose right operand, or a template literal whose
    substitutions, name outside input; once per line, where they begin.
    """
    tokens = F.col("script_tokens")

    def lines_of_rule(rule: dict) -> Column:
        def fires(t: Column) -> Column:
            within = F.slice(tokens, t["id"] + 2, t["last"] - t["id"])
            named = F.exists(
                within, lambda x: (x["kind"] == "name") & F.rlike(x["text"], F.lit(rule["words"]))
            )
            return F.when((t["kind"] == rule["kind"]) & (t["text"] == rule["text"]), named)

        return F.array_distinct(
            F.transform(F.filter(tokens, lambda t: F.coalesce(fires(t), F.lit(False))), lambda t: t["line"])
        )

    def of_rule(rule: dict, lines: Column) -> Column:
        return F.transform(
            lines_of_rule(rule), lambda n: rules.finding(rule, n, F.get(lines, n - 1))
        )

    def found(lines: Column) -> Column:
        return F.concat(*[of_rule(rule, lines) for rule in JS_RULES.values()])

    return arrays.let(text.lines_of(F.col("content")), found).cast(rules.FINDING_ARRAY)


def js_rule_findings(files: DataFrame) -> DataFrame:
    """Findings of the two JavaScript rules, from the tokens of scripts."""
    return (
        files.where(may_match_js())
        .withColumn("script_tokens", scripts.script_tokens("content"))
        .select(*KEY, F.inline(js_finding_array()))
    )


def import_rule_findings(files: DataFrame) -> DataFrame:
    return imports_as_findings(python_imports(files)).unionByName(
        imports_as_findings(js_imports(files))
    )


def structural_findings(files: DataFrame) -> DataFrame:
    return (
        import_rule_findings(files)
        .unionByName(python_rule_findings(files))
        .unionByName(js_rule_findings(files))
    )

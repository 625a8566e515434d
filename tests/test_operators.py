from __future__ import annotations

import ast
import keyword
import statistics
from collections import Counter

import pytest
from conftest import JS_SAMPLE, PY_SAMPLE
from pyspark.sql import functions as F

from codeveritas import schemas
from codeveritas.operators import (
    dependencies, findings, heuristics, rules, scoring, structural, style, symbols, syntax,
    watermark,
)
from codeveritas.plans import trust_report as plan


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- symbols ---------------------------------------------------------------


def test_python_symbols(make_files):
    df = make_files(("m.py", PY_SAMPLE))
    assert rows(symbols.python_functions(df), "line_no", "name", "parameter_count") == [
        (9, "fetch", 2), (17, "process", 1), (24, "run", 3),
    ]
    assert rows(symbols.python_imports(df), "line_no", "module", "is_from") == [
        (2, "os", False), (3, "json", False), (3, "numpy", False), (4, "pathlib", True),
        (5, "no_such_pkg.inner", True), (6, ".", True),
    ]
    fixed = symbols.python_imports(df, accept_parenthesised=True)
    assert (6, ".") not in rows(fixed, "line_no", "module")
    profile = symbols.file_profile(df).first()
    lines = PY_SAMPLE.split("\n")
    solid = [len(x) for x in lines if x.strip()]
    assert (profile.line_count, profile.blank_lines) == (len(lines), len(lines) - len(solid))
    assert profile.avg_line_length == pytest.approx(statistics.mean(solid))
    assert (profile.max_line_length, profile.class_count) == (max(solid), 1)
    assert profile.has_type_hints


def test_parenthesised_imports_only_in_the_wider_form(make_files):
    df = make_files(("m.py", "from a.b import (\n    c,\n)\nfrom d import *\n"))
    assert rows(symbols.python_imports(df), "module") == []
    wide = symbols.python_imports(df, accept_parenthesised=True)
    assert rows(wide, "line_no", "module") == [(1, "a.b"), (4, "d")]


def test_import_after_blank_lines_reports_its_own_line(make_files):
    df = make_files(("m.py", "x = 1\n\n\nimport yaml\n"))
    assert rows(symbols.python_imports(df), "line_no", "module") == [(4, "yaml")]
    loose = symbols.python_imports(df, at_match_start=True)
    assert rows(loose, "line_no", "module") == [(2, "yaml")]


def test_multiline_parameters(make_files):
    df = make_files(("m.py", "def f(\n    a,\n    b,\n):\n    pass\ndef g():\n    pass\n"))
    got = rows(symbols.python_functions(df), "line_no", "name", "parameter_count")
    assert got == [(1, "f", 2), (6, "g", 0)]


def test_js_symbols(make_files):
    df = make_files(("m.ts", JS_SAMPLE))
    assert rows(symbols.js_imports(df), "line_no", "module") == [
        (1, "react"), (2, "no-such-js"), (3, "./local.css"),
    ]
    assert rows(symbols.js_functions(df), "line_no", "name") == [(7, "fetchUser"), (12, "go")]
    assert symbols.class_counts(df).first().class_count == 1


# --- dependencies ------------------------------------------------------------


def test_unknown_dependencies(spark, make_files):
    df = make_files(("m.py", PY_SAMPLE), ("m.js", JS_SAMPLE))
    registry = spark.createDataFrame(
        [("pypi", "numpy"), ("npm", "react")], schemas.REGISTRY
    )
    unknown = dependencies.unknown_dependencies(symbols.imports(df), registry)
    # The relative import's root is empty and so unknown, as "." is looked up.
    assert rows(unknown, "file_path", "package_name", "line_no", "registry") == [
        ("m.js", "no-such-js", 2, "npm"),
        ("m.py", ".", 6, "pypi"),
        ("m.py", "no_such_pkg.inner", 5, "pypi"),
    ]
    only_npm = registry.where("registry = 'npm'")
    open_ = dependencies.unknown_dependencies(symbols.imports(df), only_npm)
    assert rows(open_, "registry") == [("npm",)]


# --- findings ------------------------------------------------------------------


def test_line_rules(make_files):
    df = make_files(("m.js", JS_SAMPLE), ("clean.py", "x = 1\n"))
    assert rows(rules.scan_rules(df), "line_start", "rule_id", "severity") == [
        (5, "hardcoded-api-key", "critical"),
        (8, "missing-llm-error-handling", "medium"),
        (9, "unvalidated-llm-response", "critical"),
    ]
    scored = findings.findings_score(findings.severity_counts(rules.scan_rules(df)), df).first()
    assert scored.findings_score == 100 - 2 * 25 - 8


def test_word_list_of_executed_output(make_files):
    assert rules.scan_rules(make_files(("a.js", "eval(res.text)"))).count() == 0
    assert rules.scan_rules(make_files(("a.js", "EVAL ( Response"))).count() == 1


def test_clean_scan_scores_100(make_files):
    df = make_files(("a.py", "x = 1\n"))
    got = findings.findings_score(findings.severity_counts(rules.scan_rules(df)), df).first()
    assert got.findings_score == 100.0


def test_snippet_is_cut_at_200(make_files):
    line = "  temperature = 2 " + "z" * 500
    got = rules.scan_rules(make_files(("a.py", line))).first()
    assert got.snippet == line.strip()[:200]


def test_dedup_prefers_the_structural_source(spark):
    base = ("s", "f.py", "r1", "c", "low", 1, 1)
    make = lambda m: spark.createDataFrame(
        [(*base, m, None, None)], schemas.FINDINGS
    )
    merged = findings.union_findings(
        external=make("e"), line=make("l"), structural=make("s")
    )
    got = findings.dedup_findings(merged).collect()
    assert [r.message for r in got] == ["s"]


STRUCTURAL = """import openai
openai.api_key = "abc"
client = openai.OpenAI(api_key="abc")
eval(data["content"])
exec(other)
r = client.chat.completions.create(model="m", temperature=0.5)
try:
    if True:
        r = client.chat.completions.create(model="m")
except ValueError:
    r = client.chat.completions.create(model="m")
p = f"hi {user_name} {total}"
q = f"hi {total}"
s = "a {}".format(total)
t = name.format(total)
"""


def test_python_structural_rules(make_files):
    got = rows(
        structural.python_rule_findings(make_files(("m.py", STRUCTURAL))), "line_start", "rule_id"
    )
    assert got == [
        (2, "hardcoded-openai-key"), (3, "hardcoded-openai-key"), (4, "eval-llm-output"),
        (6, "insecure-llm-no-content-filter"), (6, "no-error-handling-openai"),
        (12, "prompt-injection-fstring"), (14, "prompt-injection-format"),
    ]


def test_js_structural_rules(make_files):
    body = "a = base + userName\nb = base + total\nc = `x ${req.body}`\nd = `x ${total}`\n"
    got = rows(structural.js_rule_findings(make_files(("m.js", body))), "line_start", "rule_id")
    assert got == [(1, "prompt-injection-concat-js"), (3, "prompt-injection-template-literal")]


# --- style features ----------------------------------------------------------------

BRANCHES = {
    ast.If: 1, ast.IfExp: 1, ast.For: 1, ast.AsyncFor: 1, ast.While: 1, ast.ExceptHandler: 1,
    ast.With: 1, ast.AsyncWith: 1, ast.Assert: 1,
}


def complexity(tree):
    total = 1
    for node in ast.walk(tree):
        total += BRANCHES.get(type(node), 0)
        if isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            total += len(node.generators)
    return total


def depth(node):
    return 1 + max((depth(c) for c in ast.iter_child_nodes(node)), default=0)


def test_syntax_features_match_a_direct_walk(make_files):
    got = style.features_batch(make_files(("m.py", PY_SAMPLE))).first()
    tree = ast.parse(PY_SAMPLE)
    nodes = list(ast.walk(tree))
    inner = [n for n in nodes if list(ast.iter_child_nodes(n))]
    functions = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    assert got.ast_node_count == len(nodes)
    assert got.ast_depth == depth(tree)
    assert got.ast_unique_node_types == len({type(n) for n in nodes})
    assert got.ast_branching_factor == pytest.approx((len(nodes) - 1) / len(inner))
    assert got.cyclomatic_complexity == complexity(tree)
    assert got.avg_function_complexity == pytest.approx(
        statistics.mean(complexity(f) for f in functions)
    )
    assert (got.num_functions, got.num_classes, got.import_count) == (3, 1, 5)
    assert got.max_nesting_depth == 2
    assert got.has_docstrings == 1.0
    names = []
    for n in nodes:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            names += [n.name, *[a.arg for a in n.args.args]]
        elif isinstance(n, ast.ClassDef):
            names.append(n.name)
        elif isinstance(n, ast.Name):
            names.append(n.id)
        elif isinstance(n, ast.Attribute):
            names.append(n.attr)
    names = [n for n in names if n not in keyword.kwlist and n not in style.BUILTINS]
    assert got.avg_identifier_length == pytest.approx(statistics.mean(map(len, names)))
    assert got.std_identifier_length == pytest.approx(statistics.stdev(map(len, names)))
    assert got.single_char_ratio == pytest.approx(sum(len(n) == 1 for n in names) / len(names))


def test_token_features(make_files):
    code = "for x in y:\n    if x: print(x + x)\n"
    got = style.features_batch(make_files(("m.py", code))).first()
    tokens = "for x in y : if x : print ( x + x )".split()
    assert got.keyword_ratio == pytest.approx(3 / len(tokens))
    assert got.for_loop_ratio == pytest.approx(1 / len(tokens))
    assert got.operator_diversity == len({":", "(", "+", ")"})
    assert got.builtin_usage_count == 1
    assert got.unique_token_ratio == pytest.approx(len(set(tokens)) / len(tokens))
    # "x :" is no pair of the first line; (":" "if") and the rest occur once.
    assert got.bigram_repetition_score == 0.0


def test_empty_and_broken_code(make_files):
    df = style.features_batch(make_files(("e.py", ""), ("b.py", "\ndef broken(\n    x 'y'\n")))
    got = {r.file_path: r for r in df.collect()}
    assert all(got["e.py"][f] == 0 for f in style.FEATURES)
    assert got["b.py"].avg_line_length > 0 and got["b.py"].ast_node_count == 0


def test_deep_code_emits_no_nodes_and_does_not_fail(make_files):
    df = make_files(("deep.py", "x = " + "(" * 5000 + "1" + ")" * 5000), ("ok.py", "x = 1"))
    found = {r.file_path for r in syntax.explode_ast_nodes(df).select("file_path").collect()}
    assert found == {"ok.py"}


def test_token_bigrams_window(make_files):
    tokens = syntax.explode_tokens(make_files(("m.py", "a = b\na = c\n")))
    got = {(r.text, r.next_text): r.pairs for r in syntax.token_bigrams(tokens).collect()}
    assert got == {("a", "="): 2, ("=", "b"): 1, ("b", "a"): 1, ("=", "c"): 1}


def test_token_bigrams_deal_files_into_many_parts(make_files):
    """No task holds more than a small share of the tokens, however well they compress."""
    files = make_files(*[(f"m{k}.py", f"a = b{k}\n") for k in range(300)])
    pairs = syntax.token_bigrams(syntax.explode_tokens(files))
    parts = pairs.withColumn("part", F.spark_partition_id()).collect()
    assert {(r.file_path, r.text, r.next_text, r.pairs) for r in parts} == {
        row for k in range(300) for row in ((f"m{k}.py", "a", "=", 1), (f"m{k}.py", "=", f"b{k}", 1))
    }
    assert max(Counter(r.part for r in parts).values()) < 60


# --- heuristic -------------------------------------------------------------------------


def test_heuristic_defaults(make_files):
    df = heuristics.heuristic_score(make_files(("a.go", "x"), ("b.go", "  \n ")))
    got = {r.file_path: r for r in df.collect()}
    assert got["b.go"].signals is None and got["b.go"].ai_probability == 0.5
    s = got["a.go"].signals
    assert (s.line_length_uniformity, s.naming_regularity, s.entropy_signal) == (0.5, 0.5, 0.5)
    assert (s.structural_regularity, s.comment_pattern, s.boilerplate_ratio) == (0.5, 0.3, 0.2)


def test_signals_do_not_depend_on_other_rows(make_files):
    body = PY_SAMPLE.replace("import", "uses")
    alone = heuristics.heuristic_score(make_files(("a.go", body))).first().ai_probability
    many = heuristics.heuristic_score(
        make_files(*[(f"{i}.go", body if i == 3 else "y" * i) for i in range(9)])
    )
    assert many.where("file_path = '3.go'").first().ai_probability == alone


# --- watermark ---------------------------------------------------------------------------


def test_known_author_hash(spark):
    df = spark.createDataFrame([("test-author", "")], "author_id string, salt string")
    got = watermark.author_hash(df).first().author_hash
    assert got.startswith("f75ff42550e77e33") and len(got) == 64


@pytest.mark.parametrize("bits", [16, 32, 64])
def test_mark_round_trip(spark, make_files, bits):
    text = "\n".join(f"line {i}" if i % 3 else "  " for i in range(120))
    df = make_files(("a.py", text), ("short.py", "one\ntwo"))
    marked = watermark.embed_for_author(df, "me", "s", bits)
    assert rows(marked.select(F.translate("content", " \t", "").alias("c")), "c") == rows(
        df.select(F.translate("content", " \t", "").alias("c")), "c"
    )
    extracted = watermark.extract_watermark(marked, bits)
    claims = spark.createDataFrame([("s1", "me", "s")], "scan_id string, author_id string, salt string")
    got = {r.file_path: r for r in watermark.watermark_confidence(
        watermark.verify_watermark(extracted, claims, bits)).collect()}
    assert got["a.py"].verified and got["a.py"].confidence == 1.0
    assert got["short.py"].verified is None and not got["short.py"].is_watermarked
    other = claims.withColumn("author_id", F.lit("you"))
    wrong = watermark.watermark_confidence(
        watermark.verify_watermark(extracted, other, bits)
    ).where("file_path = 'a.py'").first()
    assert wrong.verified is False and wrong.confidence == 0.3


def test_trailing_space_without_payload_still_counts_as_mark(make_files):
    got = watermark.extract_watermark(make_files(("a.py", "x \n" * 64))).first()
    assert got.payload == "\x00" * 8 and not got.payload_is_hex
    tail = watermark.extract_watermark(make_files(("a.py", "x\u00a0\n" * 64))).first()
    assert tail.payload is None


# --- scores ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a,f,w,want",
    [(100, 100, 100, 100), (0, 0, 0, 0), (80, 60, 90, 74.5), (100, 0, 100, 60),
     (0, 100, 100, 65), (75, 50, 90, 68.75)],
)
def test_composite(spark, a, f, w, want):
    df = spark.range(1).select(
        scoring.composite(F.lit(float(a)), F.lit(float(f)), F.lit(float(w))).alias("x")
    )
    assert df.first().x == pytest.approx(want)


def test_scan_corpus(spark, make_files):
    df = make_files(("m.py", PY_SAMPLE), ("m.js", JS_SAMPLE), ("empty.go", "")).unionByName(
        make_files(("ok.go", "package main\n"), scan="s2")
    )
    registry = spark.createDataFrame([("pypi", "numpy"), ("npm", "react")], schemas.REGISTRY)
    tables = plan.scan_corpus(df, registry)
    got = {r.scan_id: r for r in tables.scores().collect()}
    assert set(got) == {"s1", "s2"}
    assert got["s1"].critical_count == 2 and got["s1"].findings_score == 42.0
    assert got["s2"].findings_score == 100.0 and got["s2"].watermark_score == 0.0
    files = {r.file_path: r for r in tables.authorship.collect()}
    assert files["m.py"].ai_probability == pytest.approx(0.7)
    assert files["empty.go"].detection_method == "skipped"
    assert files["empty.go"].ai_probability == 0.0
    for r in got.values():
        want = 0.35 * r.authorship_score + 0.4 * r.findings_score + 0.25 * r.watermark_score
        assert r.trust_score == pytest.approx(want, abs=0.006)


def test_splitting_the_corpus_changes_nothing_per_file(spark, make_files):
    pairs = [("m.py", PY_SAMPLE), ("m.js", JS_SAMPLE), ("n.go", "package x\n" * 20)]
    columns = ["file_path", "line_count", "base", "payload"]
    whole = rows(plan.file_facts(make_files(*pairs)), *columns)
    parts = []
    for pair in pairs:
        parts += rows(plan.file_facts(make_files(pair)), *columns)
    assert whole == sorted(parts)


def test_report_parts_keep_every_row(spark):
    df = spark.range(2500).select(
        F.when(F.col("id") < 2400, "big").otherwise("small").alias("scan_id"),
        F.concat(F.lit("f"), "id").alias("file_path"),
    )
    parts = plan.report_parts("files", df, ["file_path"], per_part=100)
    counted = parts.select("scan_id", F.json_array_length("items").alias("n")).groupBy("scan_id").agg(
        F.sum("n").alias("n"), F.max("n").alias("largest")
    )
    got = {r.scan_id: r for r in counted.collect()}
    assert got["big"].n == 2400 and got["small"].n == 100
    assert got["big"].largest < 200


def test_facts_plan_has_no_shuffle_and_one_scan(make_files, spark, tmp_path):
    path = str(tmp_path / "files")
    make_files(("m.py", PY_SAMPLE), prepared=False).write.parquet(path)
    from codeveritas.sources.files import prepare

    facts = plan.file_facts(prepare(spark.read.parquet(path)))
    text = facts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("FileScan") == 1
    assert "LessThanOrEqual(size_bytes,512000)" in text


# Findings that an earlier form of the rules lost or made up.


def _rules_of(df):
    return sorted((r.rule_id, r.line_start) for r in df.collect())


def test_format_call_with_a_space_is_found(make_files):
    files = make_files(("a.py", 'x = "a {}".format (total)\ny = "b {}".format(total)\n'))
    found = structural.python_rule_findings(files)
    assert _rules_of(found) == [("prompt-injection-format", 1), ("prompt-injection-format", 2)]


def test_template_literal_over_several_lines(make_files):
    code = "const a = 1;\nconst p = `hello\n  there ${req.body}\n`;\nconst q = `${x}`;\n"
    found = structural.js_rule_findings(make_files(("a.js", code)))
    assert _rules_of(found) == [("prompt-injection-template-literal", 2)]


def test_only_default_imports_are_npm_findings(make_files):
    code = "import 'react';\nimport {a} from 'lib';\nimport Thing from 'thing';\n"
    found = structural.import_rule_findings(make_files(("a.js", code)))
    assert _rules_of(found) == [("ai-hallucinated-npm-import", 3)]


def test_control_character_at_line_ends_is_no_watermark(make_files):
    files = make_files(("a.py", "".join(f"x{k} = 1\u0001\n" for k in range(80))))
    assert files.first().content.count("\u0001") == 80
    assert watermark.extract_watermark(files).first().payload is None
    imports = make_files(("b.py", "\u0001\n# \u0001\nimport os\n"))
    assert [r.line_no for r in symbols.python_imports(imports).collect()] == [3]


def test_columns_of_two_frames_are_not_mixed_up(spark):
    a = spark.createDataFrame([(1, "aaaa")], "k int, code string")
    b = spark.createDataFrame([(1, "abcd")], "k int, code string")
    joined = a.join(b, a["k"] == b["k"]).select(
        heuristics.char_entropy(a["code"]).alias("x"), heuristics.char_entropy(b["code"]).alias("y")
    )
    assert tuple(joined.first()) == (0.0, 2.0)
    assert b.select(heuristics.char_entropy(b["code"]).alias("y")).first().y == 2.0


def test_many_f_strings_take_linear_time(make_files):
    import time

    def seconds(n):
        files = make_files(("a.py", "".join(f'a{k} = f"v {{k{k}}}"\n' for k in range(n))))
        start = time.time()
        assert structural.python_rule_findings(files).count() == 0
        return time.time() - start

    seconds(10)
    assert seconds(8000) < 20


def test_syntax_lists_are_columns_cut_at_files():
    import pyarrow as pa

    from codeveritas.operators import syntax

    many = "\n".join(f"x{k} = f(y, {k})" for k in range(6000))
    codes = pa.array(["def f(a):\n    return a", None, " ", "x = (", many, "if é:\n    y = 'ü' + k", many, ""])
    nodes = syntax.python_nodes.func(codes).to_pylist()
    tokens = syntax.python_tokens.func(codes).to_pylist()
    assert [len(x) > 0 for x in nodes] == [True, False, False, False, True, True, True, False]
    assert [t["text"] for t in tokens[0]] == ["def", "f", "(", "a", ")", ":", "return", "a"]
    assert [t["text"] for t in tokens[3]] == ["x", "=", "("] and nodes[4] == nodes[6]
    assert all([n["id"] for n in x] == list(range(len(x))) and (not x or x[0]["last"] == len(x) - 1) for x in nodes)
    name = next(n for n in nodes[5] if n["name"] == "str")
    assert codes[5].as_py().encode()[name["start"] : name["end"]].decode() == "'ü'"
    # What a batch holds as Python objects is bounded by _CHUNK and one file.
    held = []
    syntax._mapped(codes, lambda code, out: (held.append(len(out[0])), syntax._nodes(code, out)), syntax._NODE)
    assert max(held) <= syntax._CHUNK

from __future__ import annotations

import random

import pytest

from codeveritas.operators import rule_index, rules

SCHEMA = "rule_id string, pattern string, category string, severity string, message string, fix string"


@pytest.mark.parametrize("pattern, factor", [
    ("hello", "hello"), (r"foo\(bar", "foo(bar"), (r"(?:abc|abd)xyz", "xyz"), (r"(a|b)", None), (r"ab*cdef", "cdef"),
    (r"(?:token)+=\w", "token"), (r"x(?:yz)?long_word.*tail", "long_word"), (r"[Kk]ey_name", "ey_name"), (r"a{3}b", None),
    (r"API_KEY\s*=", "api_key"), (r"(?P<n>name)d", "named"), (r"naïve_thing", "ve_thing"), (r"\p{L}+abc", None), ("", None),
    (r"^start\bend$", "startend"), (r"(?=look)ahead", "ahead"), (r"one\ntwo_", "two_"), (r"(?i:abcd)e", None), (r"(", None),
])
def test_required_factors(pattern, factor):
    got = rule_index.required_factor(pattern)
    # Case-insensitive groups and the like may be looked into or not; a factor must be right if there is one.
    assert got == factor or got is None or (factor is None and got in pattern.lower())


def row(k, pattern):
    return (f"r{k}", pattern, "insecure_llm_call", "low", "m", None)


def as_rules(table):
    return [dict(zip(("rule_id", "pattern", "category", "severity", "message", "fix"), r)) for r in table if r[1] is not None]


def answer(df):
    return sorted(tuple(r) for r in df.select("file_path", "line_start", "rule_id", "severity", "snippet").collect())


def test_equals_the_nested_loop(spark, make_files):
    draw = random.Random(4)
    words = ["token", "secret", "KEY", "eval(", "user", "ünï", "x", "ſecret", "Kelvin", "a.b"]
    body = lambda: "\n".join(" ".join(draw.choice(words) for _ in range(draw.randint(0, 6))) for _ in range(40))
    files = make_files(*[(f"f{k}.go", body()) for k in range(8)], ("empty.go", ""))
    patterns = [r"token.*secret", r"eval\(", r"(?:user|token)x", r"\bkey\b", r"[xy] [xy]", r"ünï", r"a\.b", r"secret", r"kelvin", None, r"^$", r"(?:secret ){2}", "key"]
    table = [row(k, p) for k, p in enumerate(patterns)] + [row(99, "key")]
    df = spark.createDataFrame(table, SCHEMA)
    want = answer(rules.scan_rules(files, as_rules(table)))
    assert len({w[2] for w in want}) > 8
    for block in (50_000, 3):
        assert answer(rule_index.scan_rule_table(files, df, block)) == want


def test_ten_thousand_rules(spark, make_files):
    draw = random.Random(6)
    table = [row(k, rf"pkg_{k}\b.*(?:end|stop)") for k in range(10_000)]
    lines = [f"use pkg_{draw.randrange(12_000)} then {draw.choice(['end', 'go', 'stop pkg_7 end'])}" for _ in range(400)]
    files = make_files(("a.go", "\n".join(lines[:200])), ("b.go", "\n".join(lines[200:])))
    got = rule_index.scan_rule_table(files, spark.createDataFrame(table, SCHEMA)).select("file_path", "line_start", "rule_id").collect()
    import re

    want = set()
    for k, line in enumerate(lines):
        for m in re.finditer(r"pkg_(\d+)\b", line):
            if int(m[1]) < 10_000 and re.search(r"(?:end|stop)", line[m.end():]):
                want.add(("a.go" if k < 200 else "b.go", k % 200 + 1, f"r{m[1]}"))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_large_table_reads_the_texts_once(spark, make_files):
    table = [row(k, rf"pkg_{k}\b") for k in range(60)] + [row(k, rf"mod{k % 7}_name{k}") for k in range(60, 90)]
    files = make_files(("a.go", "pkg_1 pkg_12x pkg_59\npkg_5"), ("b.go", "mod4_name60\nPKG_\n7 mod6_na\nme62 pkg_59 pkg_60"))
    df = spark.createDataFrame(table, SCHEMA)
    for block in (1, 20, 80):
        found = rule_index.scan_rule_table(files, df, block)
        assert answer(found) == answer(rules.scan_rules(files, as_rules(table)))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_empty_tables(spark, make_files):
    files = make_files(("a.go", "token"))
    none = spark.createDataFrame([], SCHEMA)
    got = rule_index.scan_rule_table(files, none)
    assert got.columns == rules.scan_rules(files).columns and got.count() == 0
    assert rule_index.scan_rule_table(files.limit(0), spark.createDataFrame([row(1, "token")], SCHEMA)).count() == 0

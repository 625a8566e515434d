"""The script automaton and the rules over its tokens."""

from __future__ import annotations

import pytest

from codeveritas.operators import scripts, structural


def words(code):
    return [t["text"] for t in scripts.lex(code)]


@pytest.mark.parametrize("code, expected", [
    ("a = b / c / d", ["a", "=", "b", "/", "c", "/", "d"]),
    ("a = /b+user/g.test(c)", ["a", "=", "/b+user/g", ".", "test", "(", "c", ")"]),
    ("return /[/`]x/", ["return", "/[/`]x/"]),
    ("x = (a) / 2 + 'it''s'", ["x", "=", "(", "a", ")", "/", "2", "+", "'it'", "'s'"]),
    ("// user + 1\na /* `${user}` */ + b", ["a", "+", "b"]),
    ("'a + user' + \"\\\"${x}\"", ["'a + user'", "+", "\"\\\"${x}\""]),
    ("i++ + ++j", ["i", "++", "+", "++", "j"]),
    ("a?.b ?? 1.5e-3 ?.5:0x1F", ["a", "?.", "b", "??", "1.5e-3", "?", ".5", ":", "0x1F"]),
    ("`a ${b + `c ${d}` } e` / f", ["`", "b", "+", "`", "d", "/", "f"]),
    ("`${ {a: {b: 1}}.a } }`;z", ["`", "{", "a", ":", "{", "b", ":", "1", "}", "}", ".", "a", ";", "z"]),
    ("`open ${a", ["`", "a"]),
    ("'open", ["'open"]),
    ("/* open", []),
    ("", []),
])
def test_tokens(code, expected):
    assert words(code) == expected


def test_lines_and_extents():
    tokens = scripts.lex("a\n/* x\n y */ `p\n${q\n+ r}` + s.t[u](v)\nw")
    assert [(t["text"], t["line"]) for t in tokens] == [
        ("a", 1), ("`", 3), ("q", 4), ("+", 5), ("r", 5), ("+", 5), ("s", 5), (".", 5), ("t", 5), ("[", 5), ("u", 5),
        ("]", 5), ("(", 5), ("v", 5), (")", 5), ("w", 6)]
    within = {t["id"]: [x["text"] for x in tokens[t["id"] + 1 : t["last"] + 1]] for t in tokens if t["last"] > t["id"]}
    assert within == {1: ["q", "+", "r"], 3: ["r"], 5: ["s", ".", "t", "[", "u", "]", "(", "v", ")"]}


def test_every_prefix_of_a_script_is_cut_without_an_error():
    code = "f(`a ${b + `c ${{d: /[`}]/}}`} e`, 'x\\'', \"y\", /* z */ 1 / 2) // end\n"
    for k in range(len(code)):
        tokens = scripts.lex(code[:k])
        assert [t["id"] for t in tokens] == list(range(len(tokens)))
        assert all(t["id"] <= t["last"] < len(tokens) for t in tokens)


def findings(make_files, code):
    found = structural.js_rule_findings(make_files(("a.ts", code))).collect()
    return sorted((r.rule_id.removeprefix("prompt-injection-"), r.line_start, r.snippet) for r in found)


def test_nothing_fires_in_comments_strings_and_regular_expressions(make_files):
    code = (
        "// p + userName\n/* `${req.body}`\n + input */\nconst a = 'x + user';\nconst b = \"`${query}`\";\n"
        "const c = /a+user/;\nconst d = `plain + user`;\nconst e = `\\${user}`;\n"
    )
    assert findings(make_files, code) == []


def test_operands_and_nested_templates(make_files):
    code = (
        "a = base + (x || req.query);\n"
        "b = base + total; userName = 1;\n"
        "c = base\n  + ctx.params.id;\n"
        "d = `one ${ `two ${ user.id }` }`;\n"
        "e = `x ${total} y` + `${'user'}`;\n"
        "f = [1 + 2, user];\n"
        "g = total + 2 * user.age;\n"
        "h = +user;\n"
        "i = `a\n ${m.message}`;\n"
    )
    assert findings(make_files, code) == [
        ("concat-js", 1, "a = base + (x || req.query);"), ("concat-js", 4, "+ ctx.params.id;"), ("concat-js", 8, "g = total + 2 * user.age;"),
        ("template-literal", 5, "d = `one ${ `two ${ user.id }` }`;"), ("template-literal", 10, "i = `a")]

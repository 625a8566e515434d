"""JavaScript and TypeScript tokens.

A small automaton cuts a script into tokens: what it expects next depends on the token before (a slash
begins a regular expression after an operator and divides after an operand) and on a stack of open
template literals.  Comments, the characters of strings, regular expressions and template literals
give no tokens of their own, so rules over tokens cannot fire in them.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers get these functions by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: kind is name, number, string, regex, template or punct; `last` is the last token inside a template or
#: of the right operand of a binary plus (its own number for others); depth counts open brackets and
#: templates; line starts at 1.
_FIELDS = ("id", "last", "depth", "line", "kind", "text")
TOKENS = T.ArrayType(T.StructType([
    T.StructField(f, T.StringType() if f in ("kind", "text") else T.IntegerType()) for f in _FIELDS
]))
_TOKEN = pa.struct([(f, pa.string() if f in ("kind", "text") else pa.int32()) for f in _FIELDS])

_SKIP = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*.*?(?:\*/|\Z)|<!--[^\n]*|\A#![^\n]*)+", re.S)
_WORD = re.compile(r"(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<name>[^\W\d][\w$‌‍]*|[$#@][\w$]*|\\u[\w{}]+)")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_PUNCT = re.compile(r"\?\.(?!\d)|=>|\+\+|--|\*\*=?|[=!]==?|<=|>=|&&=?|\|\|=?|\?\?=?|[-+*/%&|^]=|\.\.\.|.", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)

# After these names an expression begins, so a slash is no division.
_BEFORE_EXPRESSION = frozenset(
    "return typeof instanceof in of new delete void throw case do else yield await".split()
)


# What may stand between the tokens of a plus operand, besides what it holds in brackets.
_IN_OPERAND = frozenset(". ?. ( ) [ ] { } ! ~ * / % **".split())


def _operand(tokens: list[dict], plus: int) -> int:
    """The last token of the right operand of a plus; the plus itself if it is unary."""
    before = tokens[plus - 1] if plus else None
    if before is None or before["kind"] == "punct" and before["text"] not in (")", "]", "}"):
        return plus
    if before["kind"] == "name" and before["text"] in _BEFORE_EXPRESSION:
        return plus
    depth, k, ended = tokens[plus]["depth"], plus + 1, False
    while k < len(tokens) and tokens[k]["depth"] >= depth:
        token = tokens[k]
        if token["depth"] == depth:
            operand = token["kind"] != "punct"
            # Two operands without anything between them are two statements.
            if not operand and token["text"] not in _IN_OPERAND or operand and ended:
                break
            ended = operand or token["text"] in (")", "]", "}")
            if operand and token["kind"] == "name" and token["text"] in _BEFORE_EXPRESSION:
                ended = False
        k += 1
    return k - 1


def _may_begin_regex(kind: str, text: str) -> bool:
    if kind == "name":
        return text in _BEFORE_EXPRESSION
    return kind == "" or kind == "punct" and text not in (")", "]", "}", "++", "--")


def lex(code: str) -> list[dict]:
    """All tokens of a script; unfinished literals end with the text."""
    out: list[dict] = []
    # Open brackets, and template literals by the number of their token.
    open_: list[int | str] = []
    at, line, kind, text = 0, 1, "", ""

    def add(what: str, value: str) -> None:
        nonlocal kind, text
        kind, text = what, value
        out.append({"id": len(out), "last": len(out), "depth": len(open_), "line": line, "kind": what, "text": value})

    def template(begin: int) -> int:
        """Passes over characters of the innermost template, to its end or the next substitution."""
        nonlocal line, kind, text
        end = _TEMPLATE.match(code, begin).end()
        line += code.count("\n", begin, end)
        if code.startswith("${", end):
            open_.append("${")
            kind, text = "punct", "{"
            return end + 2
        out[open_[-1]]["last"] = len(out) - 1
        open_.pop()
        kind, text = "template", "`"
        return end + 1

    while at < len(code):
        begin, skipped = at, _SKIP.match(code, at)
        if skipped:
            at = skipped.end()
            line += code.count("\n", begin, at)
            continue
        c = code[at]
        if c == "`":
            add("template", "`")
            open_.append(len(out) - 1)
            at = template(at + 1)
            continue
        if c == "}" and open_ and open_[-1] == "${":
            open_.pop()
            at = template(at + 1)
            continue
        found = _WORD.match(code, at)
        if found:
            add(found.lastgroup, found.group())
        elif c in "'\"":
            found = _STRING.match(code, at)
            add("string", found.group())
        elif c == "/" and _may_begin_regex(kind, text) and (found := _REGEX.match(code, at)):
            add("regex", found.group())
        else:
            found = _PUNCT.match(code, at)
            value = found.group()
            if value in (")", "]", "}") and open_ and isinstance(open_[-1], str) and open_[-1] != "${":
                open_.pop()
            add("punct", value)
            if value in ("(", "[", "{"):
                open_.append(value)
        at = found.end()
        line += found.group().count("\n")
    for k in open_:
        if isinstance(k, int):
            out[k]["last"] = len(out) - 1
    for k, token in enumerate(out):
        if token["text"] == "+" and token["kind"] == "punct":
            token["last"] = _operand(out, k)
    return out


@F.arrow_udf(TOKENS)
def script_tokens(codes: pa.Array) -> pa.Array:
    return pa.array([[] if code is None else lex(code) for code in codes.to_pylist()], type=pa.list_(_TOKEN))

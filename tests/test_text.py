"""Text rules: each case states what Python does with the same string."""

from __future__ import annotations

import math
import re
import statistics
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeveritas.functions import arrays, text
from codeveritas.operators import heuristics, style

AWKWARD = [
    "", " ", "\n", "a\n", "a\n\nb", "tail \u00a0", "\u3000x\u2003", "x\x1c", "éa_1 b2", "😀😀a",
    "line\u2028same", "ſecret", "a\tb \n\t c  ", "=" * 50, "ab" * 40,
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def entropy(symbols):
    total = len(symbols)
    return -sum(c / total * math.log2(c / total) for c in Counter(symbols).values())


def test_whitespace_is_exactly_pythons():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_split(spark):
    assert column(spark, AWKWARD, text.rstrip) == [s.rstrip() for s in AWKWARD]
    assert column(spark, AWKWARD, text.lstrip) == [s.lstrip() for s in AWKWARD]
    assert column(spark, AWKWARD, text.lines_of) == [s.split("\n") for s in AWKWARD]


def test_words_and_characters(spark):
    assert column(spark, AWKWARD, text.words_of) == [re.findall(r"\w+", s) for s in AWKWARD]
    assert column(spark, AWKWARD, text.characters_of) == [list(s) for s in AWKWARD]


def test_dot_stops_only_at_newline(spark):
    values = ["f'\u2028user", "f'\nuser", "f'\x85 user"]
    got = column(spark, values, lambda c: text.matches(c, "f'.*user"))
    assert got == [bool(re.search("f'.*user", v)) for v in values] == [True, False, True]


def test_case_folding(spark):
    values = ["ſecret", "SECRET", "Kelvin", "lİne", "lıne", "plain"]
    for word in ("secret", "kelvin", "line"):
        want = [bool(re.search(word, v, re.I)) for v in values]
        assert column(spark, values, lambda c: text.matches(c, word, ignore_case=True)) == want
        assert column(spark, values, lambda c: text.fold_case(c).contains(word)) == want


def test_normalise_bytes(spark):
    raw = [b"ok\xff\xfez", b"a\r\nb\rc\n", b"\x01mark"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = [r.x for r in df.select("i", text.normalise(F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == ["ok\ufffd\ufffdz", "a\nb\nc\n", "\x01mark"]


@pytest.mark.parametrize(
    "name,ext",
    [("a/b.PY", ".py"), ("x.tar.gz", ".gz"), (".bashrc", ""), ("a/Dockerfile", ""), ("a.R", ".r")],
)
def test_extension(spark, name, ext):
    assert column(spark, [name], text.extension_of) == [ext]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \tc\n'\"#é😀", max_size=60), min_size=1, max_size=20))
def test_statistics_match_python(spark, values):
    got = column(spark, values, heuristics.char_entropy)
    assert got == pytest.approx([entropy(v) if v else 0.0 for v in values], abs=1e-9)
    words = column(
        spark, values, lambda c: arrays.repeated_total(arrays.pairs(text.words_of(c)))
    )
    want = []
    for v in values:
        w = re.findall(r"\w+", v)
        pairs = Counter(zip(w, w[1:], strict=False))
        want.append(sum(n for n in pairs.values() if n > 1))
    assert words == want
    lengths = column(
        spark, values,
        lambda c: arrays.let(
            arrays.moments(F.transform(text.lines_of(c), F.length)), arrays.sample_std
        ),
    )
    stds = [[len(x) for x in v.split("\n")] for v in values]
    assert lengths == pytest.approx(
        [statistics.stdev(x) if len(x) > 1 else 0.0 for x in stds], abs=1e-9
    )


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a#'\" ", max_size=14), min_size=1, max_size=40))
def test_inline_comment_is_a_quote_toggle(spark, values):
    def toggled(line):
        s, quoted = line.strip(), False
        if not s or s.startswith("#"):
            return False
        for ch in s:
            if ch in "'\"":
                quoted = not quoted
            elif ch == "#" and not quoted:
                return True
        return False

    assert column(spark, values, style.has_inline_comment) == [toggled(v) for v in values]

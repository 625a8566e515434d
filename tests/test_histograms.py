from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeveritas.functions import histograms
from codeveritas.operators import heuristics


def entropy(text):
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def texts():
    draw = random.Random(1)
    stocks = ["ab", "abcdefghij \n", "éßÿ€x", "日本語a", "\U0001f600\U0001f601b", "\x00\x7f\x80"]
    return ["", None, "a", "aaaa"] + ["".join(draw.choice(draw.choice(stocks)) for _ in range(draw.randint(0, 400))) for _ in range(300)]


def test_entropies_of_any_slices(monkeypatch):
    rows = texts()
    want = [entropy(t or "") for t in rows]
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(histograms, "SLICE_BYTES", size)
        got = [x for part in histograms._slices(pa.array(rows)) for x in histograms.entropies(part)]
        assert got == pytest.approx(want, abs=1e-12)


def test_column_equals_the_sorted_form(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "k long, code string").repartition(3)
    both = df.select(histograms.char_entropy("code").alias("a"), heuristics.char_entropy(F.col("code")).alias("b"))
    assert all(abs(r.a - (r.b or 0.0)) < 1e-9 for r in both.collect())
    assert df.limit(0).select(histograms.char_entropy("code")).count() == 0


def test_signals_do_not_sort_characters(spark, make_files):
    files = make_files(("a.go", "func main() {\n}\n" * 20), ("b.py", "x = 1\n" * 30))
    plan = heuristics.heuristic_score(files)._jdf.queryExecution().executedPlan().toString()
    assert "sort_array(split" not in plan and "ArrowEvalPython" in plan

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeveritas.functions import histograms, text
from codeveritas.operators import heuristics


def lists():
    draw = random.Random(5)
    stock = ["a", "ab", "aB", "a_b", "A_b", "if", "None", "größe", "x1", "1x", "_", "_a", "camelCase", "日本", "日"]
    return [[], None, ["a"]] + [[draw.choice(stock) for _ in range(draw.randint(0, 40))] for _ in range(200)]


def expected(words):
    words = words or []
    two = Counter(zip(words, words[1:]))
    names = [w for w in words if len(w) > 1 and w.isascii() and not w[0].isdigit() and w not in heuristics.COMMON_KEYWORDS]
    camel = [w for w in names if w in ("aB", "camelCase")]
    return [len(words), len(set(words)), sum(n for n in two.values() if n > 1), len(names), sum(map(len, names)),
            sum(len(w) <= 2 for w in names), sum("_" in w and w == w.lower() for w in names), len(camel)]


def test_word_counts_of_any_slices():
    rows, known = lists(), heuristics.COMMON_KEYWORDS
    for size in (1, 7, 300):
        got = np.concatenate([histograms._word_counts(pa.array(rows[k : k + size], pa.list_(pa.string())), known) for k in range(0, len(rows), size)])
        assert got.tolist() == [expected(r) for r in rows]


def test_columns_equal_the_array_functions(spark):
    df = spark.createDataFrame([(k, None if w is None else " ".join(w)) for k, w in enumerate(lists())], "k long, code string").repartition(3)
    code = F.col("code")
    both = heuristics.with_text_counts(df, code, code.isNotNull()).select(
        heuristics.COUNTS, heuristics.arrays.let(text.words_of(code), heuristics._word_counts).alias("plain"))
    for r in both.where("code is not null").collect():
        assert [*r[0]] == [*r.plain]
    assert heuristics.with_text_counts(df.limit(0), code, F.lit(True)).count() == 0


def test_signals_do_not_sort_words(make_files):
    files = make_files(("a.go", "func main() {\n}\n" * 20), ("b.py", "x = 1\n" * 30))
    plan = heuristics.heuristic_score(files)._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" not in plan and "sort_array" not in plan

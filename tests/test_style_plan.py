from __future__ import annotations

import math
from collections import Counter

from codeveritas.operators import style


def entropy(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def test_style_features_do_not_sort_characters(make_files):
    code = "import os\nx = [1, 2]\n# " + "größe of a comment\n# " * 40
    got = style.style_features(make_files(("a.py", code), ("b.py", " \n")))
    assert "sort_array(split(code" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.file_path: r for r in got.collect()}
    assert abs(rows["a.py"].char_entropy - entropy(code)) < 1e-9
    assert rows["b.py"].char_entropy == 0.0

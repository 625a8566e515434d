from __future__ import annotations

import re

import pytest

from codeveritas.llm import mixing
from tests.llm.helpers import corpus, edge, labels, nothing  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, budget, most):
    """Share by weight; whoever is above its cap gets the cap, and the rest is shared again."""
    full, open_ = {}, dict(sizes)
    while open_:
        left = budget - sum(full.values())
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total >= most * sizes[s]]
        if not over:
            return full | {s: left * weights[s] / total for s in open_}
        for s in over:
            full[s] = most * sizes[s]
            del open_[s]
    return full


@pytest.mark.parametrize("slice_rows", [7, 4000])
def test_targets_and_budgets(spark, slice_rows):
    rows = [(i, t, [None, "b", "a", "a", "a", "é"][i % 6]) for i, t in corpus(3)]
    rows += [(900, None, "b"), (901, "", "zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df, slice_rows=slice_rows).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    assert {r.doc_id: r.size for r in got} == size
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = targets(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        # Whole epochs come before any fraction.
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        assert epochs * r.size <= r.taken <= (epochs + 1) * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(df.repartition(5), slice_rows=3).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_edge_cases(edge, nothing):
    got = mixing.mix(edge)
    assert got.count() == edge.count() and got.filter("taken > 2 * size or taken < 0 or taken is null").count() == 0
    assert mixing.mix(nothing).count() == 0

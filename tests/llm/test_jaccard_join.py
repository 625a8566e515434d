from __future__ import annotations

import itertools
import re

import pytest

from codeveritas.llm import components, jaccard_join
from tests.llm.helpers import corpus, edge, labels, nothing  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for i, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(lower)
        out[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            least[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 4])
def test_equals_brute_force(spark, seed):
    rows = [(i, t.upper() if i % 7 == 0 else t) for i, t in corpus(seed)]
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  B"), (904, "a b c"), (905, "a b c d e"), (906, "a\nb c d  e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in jaccard_join.one_of_each(df).collect()}
    assert kept == {c for _, c in brute(rows).values()}


def test_order_of_shingles_does_not_matter(spark, monkeypatch):
    rows = corpus(8, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(jaccard_join, "MOST_HEAVY", 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_edge_cases(edge, nothing):
    got = jaccard_join.jaccard_components(edge).collect()
    assert len(got) == 13
    kept = jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns and kept.count() == 13
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 502), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500, 502: 500}

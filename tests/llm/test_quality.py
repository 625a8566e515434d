from __future__ import annotations

import re
from collections import Counter

import numpy as np

from codeveritas.llm import quality
from tests.llm.helpers import corpus, edge, labels, nothing  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times, inside = Counter(runs), set()
    for k, r in enumerate(runs):
        if times[r] > 1:
            inside.update(range(k, k + 5))
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), duplicates, len(inside))


TEXTS = ["", " ", "a", "\n\n", "a b c d e a b c d e", "é x\né x\n\né x", "a\x0bb\x0cc", "# a|b\n# a|b", "x " * 30] + [t for _, t in corpus(2, 40)]


def test_statistics_equal_brute_force():
    base, _ = quality.statistics([t.encode() for t in TEXTS])
    assert [tuple(r) for r in base.tolist()] == [brute(t) for t in TEXTS]


def test_trees_learn_and_keep_directions():
    draw = np.random.default_rng(1)
    x = draw.uniform(0, 1, (4000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2)).astype(float)
    flip = draw.uniform(size=len(y)) < 0.05
    noisy = np.where(flip, 1 - y, y)
    forest = quality.grow(x, noisy, np.ones(len(y)), np.array([-1, 1, 0]))
    assert ((forest.margin(x) >= 0) == (y == 1)).mean() > 0.97
    for f, sign in ((0, -1), (1, 1)):
        rows = np.repeat(draw.uniform(0, 1, (50, 3)), 40, axis=0)
        rows[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(forest.margin(rows).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all()


def test_edge_cases(edge, nothing, labels):
    forest = quality.fit(edge, labels)
    got = quality.judge(edge, forest)
    assert got.columns.count("kept") == 1 and got.columns.count("n_words") == 1
    rows = got.collect()
    assert len(rows) == edge.count()
    for r in rows:
        b = brute(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.base_failed and r.kept)
    none = quality.fit(nothing, labels.limit(0))
    assert quality.judge(nothing, none).count() == 0
    assert quality.judge(edge, none).filter("kept = base_failed").count() == 0

from __future__ import annotations

import random
import re

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import decontaminate as d

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def fold(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = fold(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for i, t in docs:
        w, hit, found = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), sorted(hit), sorted(found))
    return out


def test_equals_brute_force_in_one_and_several_automata(spark):
    draw = random.Random(4)
    stock = [f"{c}{k}" for c in "aBé" for k in range(40)]
    text = lambda n: "".join(draw.choice(stock) + draw.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, text(draw.choice([1, 3, 9, 10, 15, 30]))) for k in range(12)] + [(50, None), (51, "!!"), (None, "x y")]
    docs = [(k, text(draw.randint(0, 40)) + (draw.choice(items[:12])[1].upper() if k % 2 else "") + text(10)) for k in range(60)] + [(100, None), (101, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [x for x in items if x[0] is not None])
    for limit in (1 << 20, 200):
        rows = d.decontaminate(a, b, block_bytes=limit).collect()
        assert {r.doc_id: (r.n_words, list(r.hit), list(r["items"])) for r in rows} == want
        for r in rows:
            cover = [w for s in r.spans for w in fold(r.text.encode()[s.start : s.end].decode())]
            assert cover == [fold(r.text)[k] for k in r.hit]


def test_edge_cases(spark, edge, nothing):
    bench = spark.createDataFrame([(1, "twice the same row"), (1, "one")], "item_id long, text string")
    got = d.decontaminate(edge, bench)
    rows = got.collect()
    assert len(rows) == edge.count() and got.columns.count("hit") == 1
    assert sorted(r.doc_id for r in rows if r.hit) == [4, 7, 7]
    assert d.decontaminate(nothing, bench).count() == 0
    assert d.decontaminate(edge, bench.limit(0)).filter("size(hit) > 0").count() == 0

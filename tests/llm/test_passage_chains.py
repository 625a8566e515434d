from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import passage_chains as chains


def test_planted_passages_and_nothing_else(spark):
    draw = random.Random(3)
    stock = [f"w{k}" for k in range(3000)]
    text = lambda n: [draw.choice(stock) for _ in range(n)]
    passages = [text(60), text(120), text(52)]
    rows, want, first = [], {}, {}
    for i in range(60):
        t = text(draw.randint(20, 200))
        if i % 3:
            k = draw.randrange(3)
            p = list(passages[k])
            for _ in range(5 if k == 1 else 0):
                p[draw.randrange(len(p))] = f"edit{draw.randrange(99)}"
            want[i] = (k, len(t), len(t) + len(p))
            first.setdefault(k, i)
            t = t + p + text(30)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = chains.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {i for i in want if i != first[want[i][0]]}
    for r in got:
        k, a, b = want[r.doc_id]
        assert want[r.other_id][0] == k and r.other_id < r.doc_id
        assert abs(r.begin - a) <= 8 and abs(r.end - b) <= 8


def test_chain_scores_equal_all_predecessors():
    draw = np.random.default_rng(2)
    for _ in range(50):
        n = int(draw.integers(1, 30))
        parts = np.column_stack((draw.integers(0, 80, n), draw.integers(0, 80, n), draw.integers(6, 12, n)))
        parts = parts[np.lexsort((parts[:, 1], parts[:, 0]))]
        score = []
        for i, (x, y, w) in enumerate(parts):
            best = 0.0
            for j in range(i):
                a, b, v = parts[j]
                if a + v <= x and b + v <= y:
                    best = max(best, score[j] - chains.GAP_COST * ((x - a - v) + (y - b - v)))
            score.append(w + best)
        got = chains.chains(parts)
        assert sorted(k for c in got for k in c) == list(range(n))
        top = got[0]
        total = parts[top[0]][2]
        for j, i in zip(top, top[1:]):
            gap = (parts[i][0] - parts[j][0] - parts[j][2]) + (parts[i][1] - parts[j][1] - parts[j][2])
            total += parts[i][2] - chains.GAP_COST * gap
        assert abs(total - max(score)) < 1e-9


def test_a_long_chain_hides_no_nearer_predecessor():
    # One passage of 500 words, then a fuzzy one of 60 words: runs of 8 with 2 words put in between.
    parts = np.array([(0, 0, 500), *[(700 + 10 * k, 800 + 8 * k, 8) for k in range(7)]])
    assert chains.chains(parts) == [[0], list(range(1, 8))]


def test_chain_scores_equal_all_near_predecessors():
    draw = np.random.default_rng(4)
    for _ in range(50):
        n = int(draw.integers(1, 60))
        parts = np.column_stack((draw.integers(0, 400, n), draw.integers(0, 400, n), draw.integers(6, 90, n)))
        parts = parts[np.lexsort((parts[:, 1], parts[:, 0]))]
        score = []
        for i, (x, y, w) in enumerate(parts):
            best = 0.0
            for j in range(i):
                a, b, v = parts[j]
                if 0 <= x - a - v <= chains.MOST_GAP and 0 <= y - b - v <= chains.MOST_GAP:
                    best = max(best, score[j] - chains.GAP_COST * ((x - a - v) + (y - b - v)))
            score.append(w + best)
        top = chains.chains(parts)[0]
        total = parts[top[0]][2]
        for j, i in zip(top, top[1:]):
            gap = (parts[i][0] - parts[j][0] - parts[j][2]) + (parts[i][1] - parts[j][1] - parts[j][2])
            total += parts[i][2] - chains.GAP_COST * gap
        assert abs(total - max(score)) < 1e-9


def _spans(spark, rows, parts=1):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {(r.doc_id, r.begin, r.end, r.other_id, r.other_begin, r.other_end) for r in chains.repeated_passages(df).collect()}


def test_first_holders_with_parts_of_a_passage_hide_no_whole_one(spark):
    draw = random.Random(7)
    text = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    p = text(60)
    for parts_held in ([p[:48]], [p[:48], p[12:]], [p[:30], p[30:]], [p[:20], p[20:40], p[40:]]):
        rows = [(k, " ".join(text(20) + part + text(20))) for k, part in enumerate(parts_held)]
        n = len(rows)
        rows += [(n, " ".join(text(30) + p + text(9))), (n + 1, " ".join(text(5) + p + text(40)))]
        for parts in (1, 3, 7):
            got = _spans(spark, rows, parts)
            assert got == {(n + 1, 5, 65, n, 30, 90)}


def test_all_places_of_a_passage(spark):
    draw = random.Random(8)
    text = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    p, q = text(60), text(50)
    rows = [
        (1, " ".join(text(10) + p + text(10))), (2, " ".join(p + text(30) + p + text(5))),
        (3, " ".join(text(7) + q + text(70) + q)), (4, " ".join(text(50) * 2)),
    ]
    assert _spans(spark, rows) == {
        (2, 0, 60, 1, 10, 70), (2, 90, 150, 1, 10, 70), (3, 127, 177, 3, 7, 57), (4, 50, 100, 4, 0, 50),
    }


def recall(spark, identity, n=200):
    """Shares of planted 60-word passages found, with replaced words and with all kinds of edits."""
    draw = random.Random(int(identity * 100))
    text = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(n):
        p = text(60)
        other = list(p)
        # The first and last word stay, so the passage has 60 words at this identity.
        for at in sorted(draw.sample(range(1, 59), round(60 * (1 - identity))), reverse=True):
            kind = draw.randrange(3) if k % 2 else 0
            other[at : at + (kind != 2)] = [] if kind == 1 else text(1)
        rows += [(2 * k, " ".join(text(20) + p + text(20))), (2 * k + 1, " ".join(text(30) + other + text(10)))]
    found = {a for a, _, _, b, _, _ in _spans(spark, rows, 4) if b == a - 1}
    return tuple(2 * len({a for a in found if (a // 2) % 2 == kind}) / n for kind in (0, 1))


def test_recall(spark):
    even = [f"w{k}" for k in range(60)]
    tenth = [w if k % 10 else f"v{k}" for k, w in enumerate(even)]
    assert len(_spans(spark, [(1, " ".join(even)), (2, " ".join(tenth))])) == 1
    for identity, least in ((0.95, 0.99), (0.9, 0.95)):
        assert min(recall(spark, identity)) >= least


def test_the_shorter_text_travels_to_the_longer_one(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d e f"), (4, "g h i"), (5, None)], "node long, text string")
    pairs = [(2, 1), (1, 2), (3, 1), (4, 3), (3, 3), (5, 1), (1, 5)]
    found = spark.createDataFrame([(a, b, [[a, b, 4]]) for a, b in pairs], "a long, b long, chains array<array<long>>")
    of = {r.node: r.text for r in texts.collect()}
    got = [(r.a, r.b, r.chains, r.left, r.right) for r in chains._with_texts(found, texts).collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted([(a, b, [[a, b, 4]], of[a], of[b]) for a, b in pairs], key=lambda r: r[:2])


def test_blocks_of_pairs_hold_each_text_once_and_are_bounded_by_both_sides():
    long = [c * 200_000 for c in "abcdefgh"]
    rows = [(k, k, [], "x", t) for k, t in enumerate(long)] + [(k, k, [], "x", long[7]) for k in range(8, 20)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("a", "b", "chains", "left", "right"), r)) for r in rows])
    got = []
    for piece, texts, left, right in chains._pair_blocks([batch]):
        assert len(set(texts)) == len(texts) and sum(map(len, texts)) <= chains.BLOCK_BYTES + 200_000
        got += zip(piece.column("a").to_pylist(), (texts[k].decode() for k in left), (texts[k].decode() for k in right))
    assert got == [(r[0], r[3], r[4]) for r in rows]


def test_common_words_extensions_and_matches_equal_plain_ones():
    draw = random.Random(9)
    for _ in range(300):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for word in a:
            new = [0]
            for k, other in enumerate(b):
                new.append(row[k] + 1 if word == other else max(new[k], row[k + 1]))
            row = new
        assert chains._matched(a, b) == row[-1]
        x, y = draw.randint(0, len(a)), draw.randint(0, len(b))
        for step, p, q in ((1, a[x:], b[y:]), (-1, a[:x][::-1], b[:y][::-1])):
            score, best, want = 0, 0, (0, 0)
            for k, (u, v) in enumerate(zip(p, q)):
                score += 1 if u == v else -1
                if best - score > chains.DROP:
                    break
                if score > best:
                    best, want = score, (k + 1, sum(s == t for s, t in zip(p[: k + 1], q[: k + 1])))
            assert chains._extension(a, b, x, y, step) == want
        low, cut, stop = draw.randint(-20, 10), draw.randint(0, len(a)), draw.choice((None, draw.randint(0, len(b))))
        high, seen = low + draw.randint(0, 20), np.zeros(4, bool)
        line = np.sort(np.array(b, np.int64) << 32 | np.arange(len(b)))
        got = chains.rematched(np.array(a, np.int64), np.array(b, np.int64), line, seen, low, high, cut, stop)
        want = [(i, j) for i in range(cut, len(a)) for j in range(len(b)) if a[i] == b[j] and low <= i - j <= high and (stop is None or j < stop)]
        assert list(zip(*map(np.ndarray.tolist, got))) == want and not seen.any()


def test_few_matches_are_joined_like_many():
    draw = np.random.default_rng(5)
    for n in [*range(1, 17)] * 5:
        places = np.unique(draw.integers(0, 30, (n, 2)), axis=0)
        x, y = places.T
        far = np.arange(20)
        many = chains.segments(np.append(x, 10_000 + 100 * far), np.append(y, 20_000 + 300 * far))
        assert chains.segments(x, y).tolist() == many[: len(many) - 20].tolist()


def test_edge_cases(edge, nothing):
    assert chains.repeated_passages(nothing).count() == 0
    for r in chains.repeated_passages(edge).collect():
        assert r.end - r.begin >= 50

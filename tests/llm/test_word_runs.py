from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import queries, word_runs as w
from codeveritas.llm.wavelet import WaveletTree


def brute(x, least=12):
    """All maximal runs, period by period, from the stretches of equal words that far apart."""
    found, known = [], set()
    for q in range(1, len(x) // 2 + 1):
        j = 0
        while j < len(x) - q:
            if x[j] != x[j + q]:
                j += 1
                continue
            s = j
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            n = j - s + q
            if n >= max(least, 2 * q) and (s, n) not in known:
                known.add((s, n))
                found.append((s, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plant(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = plant(doc_id, text)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(x for i, x in enumerate(words) if i not in gone)),
    )


def sequences(trials, seed=3):
    draw = random.Random(seed)
    for _ in range(trials):
        n, a = draw.randint(0, 140), draw.choice([1, 2, 2, 3, 5, 30])
        x = []
        while len(x) < n:
            x += [draw.randrange(a) for _ in range(draw.randint(1, 22))] * draw.randint(1, 5)
            x = x[: max(len(x) - draw.randint(0, 2), 0)]
        yield x
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [0] * 500
    yield [0, 1] * 250 + [1] + [0, 1] * 20


def test_runs_equal_brute_force():
    for x in sequences(600):
        assert [tuple(map(int, r)) for r in w.find_runs(np.array(x, np.int64))] == brute(x), x


def test_wavelet_tree_answers_like_sorting():
    draw = np.random.default_rng(1)
    x = draw.permutation(300)
    tree = WaveletTree(x, 300)
    left, right, bound = draw.integers(0, 150, 400), draw.integers(150, 301, 400), draw.integers(0, 320, 400)
    assert tree.below(left, right, bound).tolist() == [int((x[a:b] < c).sum()) for a, b, c in zip(left, right, bound)]
    want = [min((v for v in x[a:b] if v >= c), default=-1) for a, b, c in zip(left, right, bound)]
    assert tree.successor(left, right, bound).tolist() == want


def test_documents_of_a_block_do_not_meet():
    texts = [b"a " * 11, b"a " * 30, b"", b"b a " * 9 + b"a", b"x " * 40]
    for words, runs in [w.scan(texts)]:
        assert [[tuple(map(int, r)) for r in d] for d in runs] == [brute(x) for x in words]
    assert w.collapse(words[3], runs[3]) == b"b a a"


def test_query_equals_brute_force_on_whole_tables(spark, tmp_path):
    draw = random.Random(8)
    stock = [f"w{k}" for k in range(6)] + ["é", " x"]
    rows = []
    for k in range(150):
        part = lambda n: [draw.choice(stock) for _ in range(n)]
        text = draw.choice([" ", "\n", "\t "]).join(part(draw.randint(0, 30)) + part(draw.randint(1, 12)) * draw.randint(1, 6) + part(draw.randint(0, 9)))
        rows.append((k * 7, text))
    rows += [(9001, None), (9002, ""), (9003, " \n "), (9010, "one"), (9011, "z " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert got == {i: expected(i, t) for i, t in rows}


def test_blocks_of_any_size_agree(spark, edge):
    wide, narrow = (sorted((r.doc_id or -1, r.collapsed, r.runs) for r in w.word_runs(edge, block_bytes=n).collect()) for n in (1 << 30, 1))
    assert wide == narrow


def test_edge_cases(spark, edge, nothing):
    got = w.word_runs(edge)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    for k in (1, 2, 3):
        assert (by[k].n_words, by[k].runs, by[k].collapsed) == (0, [], "")
    assert [tuple(r) for r in by[10].runs] == [(0, 400, 1)] and by[10].collapsed == "x"
    assert [tuple(r) for r in by[5].runs] == [(0, 30_000, 977)] and by[5].collapsed == " ".join(f"word{k}" for k in range(977))
    assert sorted(r.collapsed for r in rows if r.doc_id == 7) == ["twice the same row"] * 2
    assert w.word_runs(nothing).count() == 0
    digests = w.digests(got).filter("doc_id = 2").first()
    assert digests.runs_sha256 == digests.collapsed_sha256 == hashlib.sha256(b"").hexdigest() and digests.start is None

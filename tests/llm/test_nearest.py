from __future__ import annotations

import numpy as np
import pytest

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import nearest as nn, queries

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, rank string, score string, shard string"


def brute(rows, k=20, every=20):
    """{query id: [(id, score)]} over (id, vector) rows that take part."""
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    width = max((len(v) for _, v in fine), default=0)
    ids = np.array([i for i, _ in fine])
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in fine])
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            by = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in by]
    return out


def answer(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in best}) for q, best in want.items()) / sum(map(len, want.values()))


def clustered(n=1500, width=24, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, width)) * 2
    x = centres[draw.integers(0, 12, n)] + draw.standard_normal((n, width)) * draw.choice([0.2, 0.8], (n, 1))
    return x * draw.uniform(0.3, 3, (n, 1))


def test_recall_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got, want = answer(queries.op12_nearest_neighbours(spark, SMALL)), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, best in got.items():
        assert len(best) == 20 and best == sorted(best, key=lambda x: (-x[1], x[0]))
        exact = dict(brute(rows, k=len(rows))[q]) if q == 0 else None
        if exact:
            assert all(exact[i] == pytest.approx(s, abs=1e-15) for i, s in best)


def test_norms_that_differ_and_several_shards(spark, monkeypatch):
    """Largest inner products of clustered vectors; long vectors win over close ones."""
    monkeypatch.setattr(nn, "TASK_ROWS", 300)
    x = clustered()
    rows = [(k, [float(v) for v in np.float32(r)]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got, want = answer(nn.nearest(df, df.filter("vec_id % 20 = 0"))), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95


def test_probing_returns_every_code_in_the_radius():
    draw = np.random.default_rng(5)
    x = draw.standard_normal((700, 16)).astype(np.float32)
    codes = nn.Codes(x, 16, float(np.linalg.norm(x.astype(float), axis=1).max()), bits=64)
    shard = nn.Shard(np.arange(700), x, codes)
    strings, words = nn._coded(codes.of_queries(x[:40].astype(float)))
    apart = np.bitwise_count(words[:, None, :] ^ shard.words[None, :, :]).sum(axis=2)
    for reach in (0, 3, 9, 17, 30):
        over = np.arange(shard.m)[None, :] > reach % shard.m
        marks = np.unpackbits(shard._probe(strings, np.repeat(reach // shard.m - over, 40, axis=0)), axis=1, count=shard.n)
        assert not ((apart <= reach) & (marks == 0)).any()
        tight = [(np.bitwise_count(strings[:, None, j] ^ shard.strings[None, :, j]) <= reach // shard.m - over[0, j]) for j in range(shard.m)]
        assert (np.any(tight, axis=0) == (marks == 1)).all()


def test_copies_are_one_entry_and_ties_go_to_smaller_ids(spark):
    """A third of all rows is one vector: its ids come back in order, from one entry a shard."""
    x = clustered(400, 8)
    rows = [(k, [float(v) for v in np.float32(x[0] * 4 if k % 3 == 0 else x[k])]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got, want = answer(nn.nearest(df, df.filter("vec_id % 20 = 0"))), brute(rows)
    assert [i for i, _ in got[60]] == list(range(0, 60, 3)) == [i for i, _ in want[60]]
    assert recall(got, want) >= 0.95
    shard = nn.Shard(np.arange(6), np.float32([[1, 0], [0, 1], [1, 0], [0, 1], [1, 0], [2, 2]]), nn.Codes(np.ones((2, 2)), 2, 3.0))
    assert shard.n == 3 and shard.copies.tolist() == [2, 3, 1]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (None, [9.0, 9.0]), (7, [3.0]), (8, [-1.0, -2.0]), (40, [0.0, 0.0]), (9, [2.0, 2.0]), (9, [2.0, 2.0]),
    ]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    ask = df.filter("vec_id % 20 = 0")
    got = nn.nearest(df, ask)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert answer(got) == {0: [(9, 6.0), (20, 5.0), (7, 3.0), (8, -5.0)], 20: [(9, 6.0), (0, 5.0), (7, 3.0), (8, -5.0)]}
    empty = df.filter("vec_id = 1")
    assert nn.nearest(empty, empty).count() == 0 and nn.nearest(df, empty).count() == 0
    alone = df.filter("vec_id = 0")
    assert nn.nearest(alone, alone).count() == 0

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from codeveritas.llm import suffix_dedup
from tests.llm.helpers import corpus, edge, labels, nothing  # noqa: F401


def brute(rows):
    first, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in first:
                gone[p : p + 100] = b"\1" * 100
            first.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, "a" * 99), (903, "a" * 100), (904, "a" * 350), (905, "ab" * 200), (906, "b" + "ab" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(suffix_dedup.dedup(df)) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    parts = list(suffix_dedup.pieces(b"x" * 1000, 300))
    windows = sorted(p for base, part in parts for p in range(base, base + len(part) - 99))
    assert windows == list(range(901))


def test_every_window_chooses_one_suffix_by_its_content():
    texts = [t.encode() for _, t in corpus(3, 40) if len(t.encode()) >= 100] + [b"ab" * 300, b"z" * 500]
    text, low, high, at, _, _ = suffix_dedup.chosen_suffixes(texts)
    choice = {}
    seen = [0] * len(texts)
    for k, a, b, x in zip(text, low, high, at):
        seen[k] += b - a + 1
        for p in range(a, b + 1):
            assert choice.setdefault(texts[k][p : p + 100], x - p) == x - p
    assert seen == [len(t) - 99 for t in texts]


def test_edge_cases(edge, nothing):
    got = suffix_dedup.dedup(edge, carry=["source", "spans", "id"], with_text=True)
    assert got.columns.count("spans") == 1 and got.columns.count("id") == 1
    rows = got.collect()
    # Two texts share id 6; the two equal rows of id 7 are one document; two rows have no id.
    assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, None, None]
    assert suffix_dedup.dedup(nothing).count() == 0


def test_merged_intervals():
    a, b = suffix_dedup.merged(np.array([5, 0, 3, 20]), np.array([9, 3, 4, 21]))
    assert list(zip(a, b)) == [(0, 4), (5, 9), (20, 21)]


def test_first_buckets_are_written_before_texts_are_exchanged(spark):
    rows = spark.createDataFrame([(k, f"{k} " * 9 + "the same words again " * 20) for k in range(30)], "doc_id long, text string")
    plan = suffix_dedup.dedup(rows.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert "_first_buckets(" not in plan and "_grouped(" in plan

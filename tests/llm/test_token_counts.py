from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import token_counts

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_library(library):
    draw = random.Random(1)
    letters = "abst'relvmd 1!é'σΣ\n<|>#"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += [
        "", "it's they're x", "'ll", "''s", "!'s", "'re're", "'r", "l'l", "don't!! <|endoftext|>x<|startoftext|>", "<|endoftext|", "Σ ΑΣ", "İ",
        "12a3", " x", "日本語 テスト", "a​b", "'S", "x_y", "\x00", "😀😀a", "ﬁ", "é", "ñ'd", "tion" * 300,
    ]
    assert token_counts.counter(PATH).counts(texts).tolist() == library(texts)


def test_state_maps_compose():
    draw = np.random.default_rng(3)
    kinds = draw.integers(0, 10, 1000).astype(np.uint8)
    state, want = 0, []
    for c in kinds:
        want.append(token_counts.EMIT[state, c])
        state = token_counts.GO[state, c]
    for chunk in (1, 7, 64, 2000):
        assert token_counts.emissions(kinds, chunk).tolist() == want


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    texts = ["internationalisation of the unbelievable " * 3, "quay 'twas the"]
    assert token_counts.Counter(PATH).counts(texts).tolist() == library(texts)


def test_edge_cases(edge, nothing, library):
    got = token_counts.count_tokens(edge, PATH)
    assert got.columns.count("n_tokens") == 1 and got.columns.count("kept") == 1
    rows = got.collect()
    assert len(rows) == edge.count()
    assert [r.n_tokens for r in rows] == library([r.text or "" for r in rows])
    assert all(r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert token_counts.count_tokens(nothing, PATH).count() == 0

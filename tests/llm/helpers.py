from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, source string, lang string, id long, tie long, node long, score double, kept boolean, "
    "size long, target double, hit string, spans string, n_words string, n_tokens string, carried string, runs string"
)


def words(draw, n, stock):
    return " ".join(draw.choice(stock) for _ in range(n))


def corpus(seed=5, n=120):
    """(id, text): unrelated texts, copies, near copies and shared passages."""
    draw = random.Random(seed)
    stock = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 6))) for _ in range(400)]
    base = [words(draw, 90, stock) for _ in range(5)]
    rows = []
    for i in range(n):
        kind, b = draw.random(), draw.choice(base)
        if kind < 0.15:
            text = b
        elif kind < 0.45:
            w = b.split()
            for _ in range(draw.randint(1, 5)):
                w[draw.randrange(len(w))] = f"new{draw.randrange(50)}"
            text = " ".join(w)
        elif kind < 0.75:
            a = draw.randint(0, len(b) - 130)
            text = words(draw, draw.randint(0, 40), stock) + b[a : a + draw.randint(90, 300)] + words(draw, draw.randint(0, 40), stock)
        else:
            text = words(draw, draw.randint(1, 60), stock)
        rows.append((i, text))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls everywhere, empty and long texts, shared ids, repeated rows, clashing columns."""
    long_text = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, long_text), (6, "same id a b c d e f g"),
        (6, "same id other text here"), (7, "twice the same row"), (7, "twice the same row"), (None, None),
        (None, "text without an id"), (8, "\u0000 odd   bytes \U0001f600 é"), (9, "a" * 5000), (10, "x " * 400),
    ]
    full = [(i, t, None if k % 2 else "s", None, 5, 5, 5, 0.5, True, 1, 1.0, *["clash"] * 6) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (5, 1, 0), (6, 0, 1), (7, None, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )

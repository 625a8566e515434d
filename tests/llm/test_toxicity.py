from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import toxicity


def made(n, seed, insults):
    draw = random.Random(seed)
    stock = ["".join(draw.choice("rstlnaeiou") for _ in range(draw.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(n):
        w = [draw.choice(stock) for _ in range(draw.randint(20, 120))]
        bad = i % 5 == 0
        for _ in range(1 + len(w) // 40 if bad else 0):
            w[draw.randrange(len(w))] = draw.choice(insults)
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_and_unseen_misspellings(spark):
    rows = made(1200, 1, ["dreckhund", "mistkopf", "blodwicht"])
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.95
    odd = made(200, 2, ["dreckhunnd", "misstkopf", "blodwichht"])
    scores = toxicity.Scorer(model).scores([t for _, t, _ in odd])
    assert scores[[k for k in range(200) if k % 5 == 0]].mean() > 3 * scores[[k for k in range(200) if k % 5]].mean()


def test_words_add_up():
    draw = np.random.default_rng(0)
    model = toxicity.Model(draw.normal(size=1 << toxicity.BUCKET_BITS), 0.3)
    for text in ("", "a", "The cat sat on the mat the cat", "é ß 12 x_y"):
        ids, counts = toxicity.bag(text)
        mean = (model.amounts[ids] * counts).sum() / (counts.sum() + toxicity.EMPTY)
        assert np.isclose(toxicity.Scorer(model).scores([text])[0], model.probability(mean))


def test_packed_bags_are_the_same_and_small():
    draw = np.random.default_rng(5)
    text = " ".join("".join(draw.choice(list("rstlnaeiou"), 7)) for _ in range(400))
    texts = ["", "a", "a cat", text, "aa " * 300, "".join(draw.choice(list("ab"), 70_000))]
    bags = [toxicity.bag(t) for t in texts]
    packed = toxicity.Packed([toxicity.pack(*b) for b in bags])
    for want, got in zip(bags, packed, strict=True):
        assert all((w == g).all() and w.dtype == g.dtype for w, g in zip(want, got, strict=True))
    assert 2 * len(packed.bags[3]) < sum(x.nbytes for x in bags[3])


def test_training_keeps_the_sample_packed(spark, monkeypatch):
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda bags, *rest: seen.append(bags) or train(bags, *rest))
    rows = made(120, 4, ["dreckhund"])
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    bags = [toxicity.bag(t) for _, t, _ in kept]
    assert all((w == g).all() for want, got in zip(bags, seen[0], strict=True) for w, g in zip(want, got))
    assert sum(map(len, seen[0].bags)) < 4 * sum(len(b) for b, _ in bags)
    plain = train(bags, np.array([r[2] for r in kept]), np.ones(len(kept), np.float32))
    assert (plain.amounts == model.amounts).all() and plain.bias == model.bias


def test_edge_cases(edge, nothing, labels):
    model = toxicity.fit(edge, labels)
    got = toxicity.score(edge, model)
    assert got.columns.count("score") == 1
    assert got.filter("score between 0 and 1").count() == edge.count()
    empty = toxicity.fit(nothing, labels.limit(0))
    assert toxicity.score(nothing, empty).count() == 0
    assert [r.score for r in toxicity.score(edge.limit(2), empty).collect()] == [0.5, 0.5]

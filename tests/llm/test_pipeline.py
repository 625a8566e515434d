from __future__ import annotations

import os
from collections import Counter

import pytest

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
import corpus_pipeline
from codeveritas.llm import toxicity
from codeveritas.llm.base import table
from codeveritas.session import write_and_read
from tests.llm import test_decontaminate, test_jaccard_join, test_suffix_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_each_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        return write_and_read(stages[name](spark, docs, SF), name)

    clean = step("toxicity", docs)
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    scored = toxicity.score(docs, model).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored if r.score < 0.5}

    single = step("ngram_jaccard_join", clean)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in single.collect()} == {c for _, c in test_jaccard_join.brute(rows).values()}

    cut = step("suffix_array_dedup", single)
    want = test_suffix_dedup.brute([(r.doc_id, r.text) for r in single.collect()])
    got = cut.collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        n, removed, runs, _ = want[r.doc_id]
        # At most three bytes of a cut character are dropped on either side of a run.
        assert n - removed - 6 * runs <= len(r.text.encode()) <= n - removed and r.n_chars == len(r.text)

    left = step("benchmark_decontamination", cut)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    found = test_decontaminate.brute([(r.doc_id, r.text) for r in got], items)
    assert {r.doc_id for r in left.collect()} == {i for i, (_, hit, _) in found.items() if not hit}
    assert all(x.columns == columns for x in (clean, single, cut, left))

    mixed = step("mixing", left)
    assert mixed.filter("taken <= 0 or taken > 2 * size").count() == 0
    assert mixed.select("doc_id").distinct().count() == mixed.count()


def test_stages_on_edge_cases(spark, edge, nothing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "twice the same row")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda rows: Counter(r.doc_id for r in rows)
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES:
            before, rows = docs, docs.collect()
            docs = write_and_read(stage(spark, docs, str(tmp_path)), name)
            kept = docs.collect()
            if before is nothing or not rows:
                assert not kept
            if name != "mixing":
                assert docs.columns == before.columns
            if name == "toxicity":
                # Rows stay whole, repeated ones and those without an id too.
                assert not ids(kept) - ids(rows) and {tuple(r) for r in kept} <= {tuple(r) for r in rows}
            elif name == "ngram_jaccard_join":
                # The repeated row once; the two texts of one id differ and stay, as do texts without words.
                assert ids(kept) == Counter({k: 1 if k == 7 else n for k, n in ids(rows).items()})
            elif name == "suffix_array_dedup":
                assert ids(kept) == ids(rows)
                short = lambda x: sorted((r.doc_id or -1, r.text or "") for r in x if len((r.text or "").encode()) < 100)
                assert not Counter(short(rows)) - Counter(short(kept))
                assert all(r.n_words == "clash" for r in kept)
            elif name == "benchmark_decontamination":
                assert ids(kept) == Counter({k: n for k, n in ids(rows).items() if k != 7})
            elif rows:
                assert not ids(kept) - ids(rows) and all(0 < r.taken <= 2 * r.size for r in kept)

"""Compiled tree ensembles against the fitted pipelines, and the scan that carries one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeveritas.operators import ensemble, style, training
from codeveritas.plans import trust_report as plan
from tests.conftest import JS_SAMPLE, PY_SAMPLE

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    rows = []
    for k in range(600):
        a, b = draw.gauss(0, 1), draw.choice([0.0, 1.0, 2.5])
        rows.append((k, a, b, 7.0, int(a * a + b + draw.gauss(0, 0.5) > 2), f"p{k % 9}"))
    return spark.createDataFrame(rows, "doc_id long, a double, b double, c double, label int, problem_id string")


def difference(spark, model, table):
    compiled = ensemble.compile_model(spark, model)
    ours = ensemble.probability(compiled, F.array(*compiled.features))
    rows = training.predict(model, table.select("doc_id", *NAMES), NAMES).withColumn("ours", ours)
    return compiled, max(abs(r.ours - r.probability) for r in rows.collect())


def test_forest_equals_the_pipeline(spark, table):
    fitted = training.train_forest(table, key="doc_id", features=NAMES, trees=25, depth=9, folds=2)
    compiled, gap = difference(spark, fitted.model, table)
    assert len(compiled.roots) == 25 and 4 <= compiled.depth <= 9 and gap <= 1e-12


def test_boosted_trees_equal_the_pipeline(spark, table):
    space = lambda rng: {"maxIter": 12, "maxDepth": 4, "stepSize": 0.2}
    fitted = training.train_boosted(table, key="doc_id", features=NAMES, trials=1, folds=2, space=space)
    compiled, gap = difference(spark, fitted.model, table)
    assert compiled.boosted and len(compiled.roots) == 12 and gap <= 1e-12


def test_trees_of_one_leaf(spark, table):
    fitted = training.train_forest(table.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(1.0)), key="doc_id", features=NAMES, trees=3, depth=2, folds=2)
    compiled, gap = difference(spark, fitted.model, table)
    assert compiled.depth == 0 and gap <= 1e-12


def test_feature_array_equals_the_feature_table(spark, make_files):
    files = make_files(("a.py", PY_SAMPLE), ("b.py", "x = (\n"), ("c.py", "def f(:\n pass"))
    wide = {r.file_path: [r[n] for n in style.FEATURES] for r in style.features_batch(files).collect()}
    from codeveritas.operators import syntax

    rows = syntax.with_syntax(files).select(
        "file_path", style.feature_array(style.feature_struct(F.col("code"), F.col("tokens"), F.col("nodes")), style.FEATURES).alias("x"))
    assert {r.file_path: list(r.x) for r in rows.collect()} == wide


def test_scan_with_model_and_rules_reads_the_files_once(spark, make_files, tmp_path):
    names = ["num_functions", "avg_line_length"]
    draw = random.Random(1)
    train = spark.createDataFrame(
        [(k, float(k % 5), draw.uniform(5, 50), int(k % 5 > 2)) for k in range(80)],
        "doc_id long, num_functions double, avg_line_length double, label int")
    model = training.train_forest(train, key="doc_id", features=names, trees=4, depth=3, folds=2).model
    body = PY_SAMPLE + "\np = f\"x {user_name}\"\n"
    make_files(("a.py", body), ("b.js", JS_SAMPLE), ("blank.py", " \n"), ("c.md", "word " * 50)).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    compiled = ensemble.compile_model(spark, model)
    facts = plan.file_facts(files, model=compiled, structural_rules=True)
    text = facts._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "Exchange" not in text

    registry = spark.createDataFrame([("pypi", "numpy")], "registry string, package string")
    tables = plan.scan_corpus(files, registry, model=model, structural_rules=True)
    rows = {r.file_path: r for r in tables.authorship.collect()}
    assert {k: r.detection_method for k, r in rows.items()} == {
        "a.py": "ml_model", "b.js": "heuristic", "blank.py": "skipped", "c.md": "heuristic"}
    direct = training.predict(model, style.style_features(files), names)
    direct = {r.file_path: r.probability for r in direct.collect()}
    unknown = rows["a.py"].unknown_imports
    assert rows["a.py"].ai_probability == pytest.approx(min(1.0, direct["a.py"] + 0.1 * unknown), abs=1e-9)

    found = {(r.file_path, r.rule_id, r.line_start) for r in tables.findings.collect()}
    from codeveritas.operators import structural

    apart = {(r.file_path, r.rule_id, r.line_start) for r in structural.structural_findings(files).collect()}
    assert apart <= found and any(r == "prompt-injection-fstring" for _, r, _ in apart)


def test_other_models_are_refused(spark, table):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    stages = [*training._feature_stages(NAMES), LogisticRegression()]
    with pytest.raises(TypeError, match="not a tree ensemble"):
        ensemble.compile_model(spark, Pipeline(stages=stages).fit(table))

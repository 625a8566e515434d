from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from codeveritas.functions.ranking import rank_by_hash, running_totals, seeded_hash
from codeveritas.operators import evaluation, style, training
from codeveritas.plans import queries_learning
from codeveritas.session import write_and_read
from codeveritas.sources.reports import write_metrics


def test_rank_by_hash_is_a_global_rank(spark):
    df = spark.range(3000).withColumn("h", seeded_hash(F.col("id"), 1))
    got = {r.id: r.rank for r in rank_by_hash(df, "h", "rank").collect()}
    order = sorted(df.collect(), key=lambda r: r.h)
    assert [got[r.id] for r in order] == list(range(1, 3001))


def test_running_totals(spark):
    df = spark.range(500).select(
        (F.col("id") % 2).alias("g"), (F.col("id") * F.col("id") % 1009 / 7.0).alias("x")
    ).distinct().withColumn("v", F.lit(2))
    got = {(r.g, r.x): r.v_before for r in running_totals(df, "x", ["v"], ["g"], 16).collect()}
    for g in (0, 1):
        xs = sorted(x for (k, x) in got if k == g)
        assert [got[(g, x)] for x in xs] == [2 * i for i in range(len(xs))]


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(1000).select("id", (F.col("id") % 37).cast("string").alias("problem_id"))
    sides = training.group_split(df).groupBy("problem_id").agg(
        F.countDistinct("is_test").alias("n"), F.first("is_test").alias("t")
    ).collect()
    assert all(r.n == 1 for r in sides)
    assert sum(r.t for r in sides) == math.ceil(0.2 * 37)


def test_group_split_with_few_groups(spark):
    df = spark.range(20).select("id", (F.col("id") % 2).cast("string").alias("problem_id"))
    assert training.group_split(df).where("is_test").select("problem_id").distinct().count() == 1


def test_folds_are_stratified(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    counts = training.stratified_folds(df, "id").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in counts if r.label == 1} == {20}
    assert {r["count"] for r in counts if r.label == 0} == {180}


def test_metrics_against_direct_counts(spark):
    data = [(i % 3 == 0, (i * 7 % 11) / 10.0) for i in range(200)]
    df = spark.createDataFrame(
        [("m", int(y), p) for y, p in data], "model string, label int, probability double"
    )
    pos = [p for y, p in data if y]
    neg = [p for y, p in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx(auc)
    m = evaluation.binary_metrics(df).first()
    tp = sum(p >= 0.5 for p in pos)
    fp = sum(p >= 0.5 for p in neg)
    assert m.precision == pytest.approx(tp / (tp + fp))
    assert m.recall == pytest.approx(tp / len(pos))


def test_one_class_only(spark):
    df = spark.createDataFrame([("m", 0, 0.1), ("m", 0, 0.2)], "model string, label int, probability double")
    m = evaluation.binary_metrics(df).first()
    assert (m.precision, m.recall, m.f1_score, m.accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert evaluation.roc_auc(df).first().roc_auc == 0.0


@pytest.mark.parametrize("boosted,forest,want", [(0.7, 0.7, "boosted"), (0.7, 0.71, "forest")])
def test_pick_best(spark, boosted, forest, want):
    df = spark.createDataFrame([("boosted", boosted), ("forest", forest)], "model string, roc_auc double")
    assert evaluation.pick_best(df).first().model == want


def test_training_finds_a_clear_signal(spark, tmp_path):
    table = spark.range(300).select(
        "id",
        (F.col("id") % 2).cast("int").alias("label"),
        (F.col("id") % 2 * 2 + F.rand(1)).alias("a"),
        F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.rand(2)).alias("b"),
    )
    fitted = training.train_forest(
        table, key="id", features=["a", "b"], trees=8, depth=4, folds=2
    )
    assert fitted.auc_mean > 0.95
    training.save_model(fitted, str(tmp_path / "model"))
    again = training.load_model(str(tmp_path / "model"))
    scored = training.predict(again, table, ["a", "b"])
    metrics = evaluation.binary_metrics(scored.withColumn("model", F.lit("m"))).first()
    assert metrics.accuracy > 0.9
    top = training.feature_importance(spark, fitted, ["a", "b"], top=1).first()
    assert top.feature == "a"
    record = training.metrics_record(
        evaluation.metrics_table(scored.withColumn("model", F.lit("m"))), {"m": fitted}, ["a", "b"]
    )
    write_metrics(record, str(tmp_path / "metrics"))
    (part,) = (tmp_path / "metrics").glob("part-*.json")
    kept = json.loads(part.read_text())
    assert kept["model_type"] == "forest" and kept["best_params"]["numTrees"] == "8"
    assert kept["cv_auc_mean"] == fitted.auc_mean and kept["accuracy"] == metrics.accuracy
    assert [f["feature"] for f in kept["feature_importances"]] == ["a", "b"]
    assert abs(sum(f["importance"] for f in kept["feature_importances"]) - 1) < 1e-9


def test_group_split_marks_samples_where_they_stand(spark):
    rows = [(k, f"p{k % 23}" if k % 31 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, problem_id string")
    split = training.group_split(df, 0.2)
    assert "Join" not in split._jdf.queryExecution().executedPlan().toString()
    sides = {}
    for r in split.collect():
        sides.setdefault(r.problem_id, set()).add(r.is_test)
    assert all(len(s) == 1 for s in sides.values()) and sides[None] == {False}
    # 24 groups with the null one: 5 of them are the test side, unless null is among the first.
    assert sum(s == {True} for s in sides.values()) in (4, 5)
    assert training.group_split(df.limit(0)).count() == 0


class _Search(Exception):
    """Stops a query where its search would begin."""


def _searched(monkeypatch, query):
    """The estimator, the parameter maps by name and the folds that a query searches with."""

    def search(estimator, grid, train, folds, parallelism):
        raise _Search(estimator, [{p.name: v for p, v in draw.items()} for draw in grid], folds)

    rows = [(k, k % 2, *[float(k)] * len(style.FEATURES)) for k in range(10)]
    columns = ", ".join(f"{c} double" for c in style.FEATURES)
    monkeypatch.setattr(training, "_cross_validate", search)
    return lambda spark: pytest.raises(_Search, query, spark.createDataFrame(rows, f"doc_id long, label int, {columns}")).value.args


def test_forest_queries_train_the_whole_forest(spark, monkeypatch):
    estimator, grid, folds = _searched(monkeypatch, queries_learning._forest)(spark)
    forest = estimator.getStages()[-1]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (500, 15, 2)
    assert folds == 5 and grid == [{}]


def test_boosted_queries_search_all_trials_and_folds(spark, monkeypatch):
    _, grid, folds = _searched(monkeypatch, queries_learning._boosted)(spark)
    assert (len(grid), folds) == (50, 5)


def test_boosted_queries_search_the_whole_space(spark, monkeypatch):
    _, grid, _ = _searched(monkeypatch, queries_learning._boosted)(spark)
    draw = random.Random(training.SEED)
    assert grid == [training.boosted_trial(draw) for _ in range(50)]
    assert max(d["maxIter"] for d in grid) > 500 and max(d["maxDepth"] for d in grid) > 10


def test_all_folds_of_a_search_share_its_fits(spark):
    table = spark.range(200).select(
        "id", (F.col("id") % 2).cast("int").alias("label"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int").alias("fold"),
        (F.col("id") % 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"),
    ).withColumn("weight", F.lit(1.0)).coalesce(1)
    table = write_and_read(table, "cross-validated")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", seed=1, numTrees=3)
    estimator = Pipeline(stages=[*training._feature_stages(["a", "b"]), forest])
    grid = [{forest.maxDepth: 1}, {forest.maxDepth: 3}]
    got = training._cross_validate(estimator, grid, table, 5, 4)
    want = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=training._evaluator(), numFolds=5, foldCol="fold",
    ).fit(table)
    assert got.avgMetrics == pytest.approx(want.avgMetrics) and got.stdMetrics == pytest.approx(want.stdMetrics)
    assert got.bestModel.stages[-1].toDebugString == want.bestModel.stages[-1].toDebugString.replace(
        want.bestModel.stages[-1].uid, got.bestModel.stages[-1].uid)
    with pytest.raises(ValueError, match="validation data at fold 4 is empty"):
        training._cross_validate(estimator, grid, table.where("fold < 4"), 5, 4)

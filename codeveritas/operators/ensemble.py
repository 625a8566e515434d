"""Fitted tree ensembles as column expressions.

A pipeline of assembler, scaler and trees is flattened into node arrays (feature, threshold, children,
value), which stand in the plan as constants.  Scoring a row walks each tree by array look-ups, so it
needs no vector type, no model stage and no second read of the text: it is an expression like any other
and can stand in the pass that derives the features.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..session import scratch_dir


@dataclass
class Ensemble:
    """Nodes of all trees one after another; leaves are their own children."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    roots: list[int]
    depth: int
    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    boosted: bool


def compile_model(spark: SparkSession, model: PipelineModel) -> Ensemble:
    """Reads the nodes from the stored form of the trees; a model fits into the driver's memory anyway."""
    assembler, scaler, trees = model.stages
    boosted = isinstance(trees, GBTClassificationModel)
    if not boosted and not isinstance(trees, RandomForestClassificationModel):
        raise TypeError(f"not a tree ensemble: {type(trees).__name__}")
    path = scratch_dir(spark, "ensemble")
    trees.write().save(path)
    split = F.col("nodeData.split")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild",
        split["featureIndex"].alias("feature"), split["leftCategoriesOrThreshold"].alias("cut"), split["numCategories"].alias("categories"),
    ).orderBy("treeID", "id").collect()
    weights = list(trees.treeWeights)
    out = Ensemble(
        list(assembler.getInputCols()), [float(x) for x in scaler.mean.toArray()],
        [0.0 if x == 0 else 1.0 / float(x) for x in scaler.std.toArray()], [], 0, [], [], [], [], [], boosted)
    level: dict[int, int] = {}
    for row in rows:
        if row.id == 0:
            out.roots.append(len(out.value))
            level = {0: 0}
        root, leaf = out.roots[-1], row.leftChild < 0
        if not leaf and row.categories >= 0:
            raise ValueError("categorical splits are not supported")
        if not leaf:
            level[row.leftChild] = level[row.rightChild] = level[row.id] + 1
        out.depth = max(out.depth, level[row.id])
        out.feature.append(0 if leaf else row.feature)
        out.threshold.append(0.0 if leaf else row.cut[0])
        out.left.append(root + (row.id if leaf else row.leftChild))
        out.right.append(root + (row.id if leaf else row.rightChild))
        if boosted:
            out.value.append(row.prediction * weights[row.treeID])
        else:
            total = sum(row.impurityStats)
            out.value.append(row.impurityStats[1] / total if total else 0.0)
    return out


def _constant(values: list, kind: str) -> Column:
    """An array that the optimiser folds into one literal; JSON keeps doubles exactly."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def probability(ensemble: Ensemble, values: Column) -> Column:
    """Probability of class 1 of an array of clean feature values, in the order of the ensemble."""
    scaled = F.zip_with(
        F.zip_with(values, _constant(ensemble.mean, "double"), lambda x, m: x - m),
        _constant(ensemble.scale, "double"), lambda x, s: x * s,
    )
    feature, threshold = _constant(ensemble.feature, "int"), _constant(ensemble.threshold, "double")
    left, right = _constant(ensemble.left, "int"), _constant(ensemble.right, "int")
    leaves, steps = _constant(ensemble.value, "double"), _constant(list(range(ensemble.depth)), "int")

    def total(x: Column) -> Column:
        def leaf(root: Column) -> Column:
            if not ensemble.depth:
                return root
            return F.aggregate(
                steps, root,
                lambda node, _: F.when(F.get(x, F.get(feature, node)) <= F.get(threshold, node), F.get(left, node)).otherwise(F.get(right, node)),
            )

        return F.aggregate(
            _constant(ensemble.roots, "int"), F.lit(0.0), lambda acc, root: acc + F.get(leaves, leaf(root))
        )

    margin = arrays.let(scaled, total)
    if ensemble.boosted:
        return 1.0 / (1.0 + F.exp(-2.0 * margin))
    return margin / float(len(ensemble.roots))

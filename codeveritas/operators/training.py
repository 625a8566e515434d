"""Training the authorship classifier with MLlib."""

from __future__ import annotations

import random
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.ranking import rank_by_hash, seeded_hash
from ..session import scratch_dir, write_and_read
from ..sources import csv_chunks
from . import style

SEED = 42


# ---------------------------------------------------------------------------
# Samples
# ---------------------------------------------------------------------------


def load_samples(spark: SparkSession, *paths: str, code: str = "code", label: str = "label",
                 problem_id: str = "problem_id") -> DataFrame:
    """CSV files with a code, a label and a problem column, concatenated.

    Code spans lines inside quotes; files are nevertheless read in chunks.
    """
    frames = []
    for path in paths:
        raw = csv_chunks.read_csv(spark, path, [code, label, problem_id])
        frames.append(samples_of(raw, code, label, problem_id))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def samples_of(df: DataFrame, code: str, label: str, problem_id: str) -> DataFrame:
    wanted = {"code": code, "label": label, "problem_id": problem_id}
    return df.select(
        *[F.col(wanted[f.name]).cast(f.dataType).alias(f.name) for f in schemas.SAMPLES.fields]
    )


def drop_blank(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("code").isNotNull() & ~text.is_blank(F.col("code")))


def shuffle_samples(samples: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """A random but repeatable order."""
    return samples.orderBy(seeded_hash(F.col(key), seed))


def label_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count("*").alias("samples"))


def group_split(samples: DataFrame, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``; all samples of a problem fall on one side.

    Problems are ranked by a seeded hash and the first ceil(test * problems)
    are the test side, so the share of problems is exact.  Only the list of
    problems is ranked: the hash of the last one that is taken decides every
    sample where it stands, so code does not move and nothing is joined.
    """
    groups = samples.select("problem_id").distinct().withColumn(
        "_h", seeded_hash(F.col("problem_id"), seed)
    )
    total = groups.count()
    cutoff = -int(-(test * total) // 1)
    last = rank_by_hash(groups, "_h", "_rank").where(F.col("_rank") == cutoff).select("_h").first()
    is_test = seeded_hash(F.col("problem_id"), seed) <= F.lit(last[0] if last else "")
    return samples.withColumn("is_test", F.coalesce(is_test, F.lit(False)))


def stratified_folds(samples: DataFrame, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0..k-1 with equal class shares."""
    hashed = samples.withColumn("_h", seeded_hash(F.col(key), seed))
    ranked = rank_by_hash(hashed, "_h", "_rank", ["label"])
    fold = F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")
    return ranked.withColumn("fold", fold).drop("_h", "_rank")


def class_weight(samples: DataFrame) -> DataFrame:
    """Positive-class weight of the boosted model and balanced class weights."""
    n = samples.agg(
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    )
    total = F.col("n_pos") + F.col("n_neg")
    return n.select(
        "n_pos",
        "n_neg",
        (F.col("n_neg") / F.greatest("n_pos", F.lit(1))).alias("scale_pos_weight"),
        (total / (2 * F.greatest("n_pos", F.lit(1)))).alias("balanced_pos"),
        (total / (2 * F.greatest("n_neg", F.lit(1)))).alias("balanced_neg"),
    )


def with_weights(samples: DataFrame, balanced: bool) -> DataFrame:
    """Adds ``weight`` from the class counts (two numbers on the driver)."""
    w = class_weight(samples).first()
    pos, neg = (w.balanced_pos, w.balanced_neg) if balanced else (w.scale_pos_weight, 1.0)
    return samples.withColumn("weight", F.when(F.col("label") == 1, pos).otherwise(neg))


# ---------------------------------------------------------------------------
# Models
# ---------------------------------------------------------------------------


def fit_scaler(train: DataFrame, features: list[str] = style.FEATURES) -> PipelineModel:
    """Assembler and scaler, fitted on training rows only.

    MLlib scales by the sample deviation (n-1); over a training set the
    difference to the population deviation is negligible.
    """
    return Pipeline(stages=_feature_stages(features)).fit(style.clean_features(train, features))


def apply_scaler(scaler: PipelineModel, df: DataFrame,
                 features: list[str] = style.FEATURES) -> DataFrame:
    return scaler.transform(style.clean_features(df, features))


def _feature_stages(features: list[str]) -> list:
    # Every feature is clean by then, so nothing has to be skipped.
    return [
        VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="error"),
        StandardScaler(
            inputCol="raw_features", outputCol="features", withMean=True, withStd=True
        ),
    ]


def _evaluator() -> BinaryClassificationEvaluator:
    # numBins 0 keeps every threshold: exact area.
    return BinaryClassificationEvaluator(
        labelCol="label", metricName="areaUnderROC", numBins=0
    )


@dataclass
class Trained:
    """A fitted pipeline, its search result and its cross-validated AUC."""

    name: str
    model: PipelineModel
    params: dict
    auc_mean: float
    auc_std: float


def _log_uniform(rng: random.Random, low: float, high: float) -> float:
    return low * (high / low) ** rng.random()


def boosted_trial(rng: random.Random) -> dict:
    """One draw of the search space (fixed bounds).

    L1 and L2 leaf penalties have no counterpart in MLlib trees.
    """
    return {
        "maxIter": rng.randrange(100, 1001, 50),
        "maxDepth": rng.randint(3, 12),
        "stepSize": _log_uniform(rng, 0.01, 0.3),
        "subsamplingRate": rng.uniform(0.6, 1.0),
        "featureSubsetStrategy": f"{rng.uniform(0.5, 1.0):.3f}",
        "minInstancesPerNode": rng.randint(1, 10),
        "minInfoGain": _log_uniform(rng, 1e-8, 5.0),
    }


@dataclass
class Validated:
    """The model of the best parameters over all folds, and each parameter map's mean and deviation."""

    bestModel: PipelineModel
    avgMetrics: list[float]
    stdMetrics: list[float]


def _cross_validate(
    estimator: Pipeline, grid: list[dict], train: DataFrame, folds: int, parallelism: int
) -> Validated:
    """What CrossValidator gives with column ``fold``, but all folds share the `parallelism` fits at a time."""
    # Every trial reads the training set again; reading it is all they do.
    stored = write_and_read(train, "training-set")
    sides = [(stored.where(F.col("fold") != i), stored.where(F.col("fold") == i)) for i in range(folds)]
    evaluator = _evaluator()

    def area(task: tuple[int, int]) -> float:
        fitted, held_out = sides[task[0]]
        return evaluator.evaluate(estimator.fit(fitted, grid[task[1]]).transform(held_out))

    for i, pair in enumerate(sides):
        for side, rows in zip(("training", "validation"), pair):
            if rows.isEmpty():
                raise ValueError(f"The {side} data at fold {i} is empty.")
    tasks = [(i, j) for i in range(folds) for j in range(len(grid))]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        areas = pool.map(inheritable_thread_target(stored.sparkSession)(area), tasks, 1)
    by_fold = np.array(areas).reshape(folds, len(grid))
    means = by_fold.mean(axis=0)
    return Validated(estimator.fit(stored, grid[int(np.argmax(means))]), means.tolist(), by_fold.std(axis=0).tolist())


def train_boosted(
    train: DataFrame,
    *,
    key: str,
    features: list[str] = style.FEATURES,
    trials: int = 50,
    folds: int = 5,
    seed: int = SEED,
    parallelism: int = 4,
    space=boosted_trial,
) -> Trained:
    """Boosted trees by random search, objective mean cross-validated AUC."""
    # A fit of 1,000 trees hangs on all rounds before unless they are cut off on disk.
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(train.sparkSession, "boosting"))
    ready = style.clean_features(
        with_weights(stratified_folds(train, key, folds, seed), balanced=False), features
    )
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", seed=seed)
    pipeline = Pipeline(stages=[*_feature_stages(features), gbt])
    rng = random.Random(seed)
    draws = [space(rng) for _ in range(trials)]
    grid = [{gbt.getParam(n): v for n, v in draw.items()} for draw in draws]
    fitted = _cross_validate(pipeline, grid, ready, folds, parallelism)
    best = max(range(trials), key=lambda i: fitted.avgMetrics[i])
    return Trained(
        "boosted", fitted.bestModel, draws[best], fitted.avgMetrics[best],
        fitted.stdMetrics[best],
    )


def train_forest(
    train: DataFrame,
    *,
    key: str,
    features: list[str] = style.FEATURES,
    trees: int = 500,
    depth: int = 15,
    folds: int = 5,
    seed: int = SEED,
    parallelism: int = 4,
) -> Trained:
    """Balanced random forest baseline with its cross-validated AUC."""
    ready = style.clean_features(
        with_weights(stratified_folds(train, key, folds, seed), balanced=True), features
    )
    params = {
        "numTrees": trees, "maxDepth": depth, "minInstancesPerNode": 2,
        "featureSubsetStrategy": "sqrt",
    }
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", seed=seed, **params
    )
    pipeline = Pipeline(stages=[*_feature_stages(features), forest])
    fitted = _cross_validate(pipeline, [{}], ready, folds, parallelism)
    return Trained(
        "forest", fitted.bestModel, params, fitted.avgMetrics[0], fitted.stdMetrics[0]
    )


def cv_scores(spark: SparkSession, *trained: Trained) -> DataFrame:
    rows = [(t.name, float(t.auc_mean), float(t.auc_std)) for t in trained]
    return spark.createDataFrame(rows, "model string, auc_mean double, auc_std double")


def feature_importance(
    spark: SparkSession, trained: Trained, features: list[str] = style.FEATURES, top: int = 15
) -> DataFrame:
    """The ``top`` features of a model by importance (a top-k report)."""
    values = trained.model.stages[-1].featureImportances.toArray().tolist()
    ranked = spark.createDataFrame(
        list(zip(features, values, strict=True)), "feature string, importance double"
    )
    order = [F.desc("importance"), F.asc("feature")]
    return (
        ranked.orderBy(*order).limit(top)
        .withColumn("rank", F.row_number().over(W.orderBy(*order)))
    )


def metrics_record(
    metrics: DataFrame, trained: dict[str, Trained], features: list[str] = style.FEATURES
) -> DataFrame:
    """The record kept beside a model: its metrics, kind, parameters, search result and importances.

    ``metrics`` has a row per model (column ``model``, the keys of ``trained``); importances
    are of all features, the most important first.
    """
    spark = metrics.sparkSession
    rows = []
    for name, fitted in trained.items():
        values = fitted.model.stages[-1].featureImportances.toArray().tolist()
        ranked = sorted(zip(features, values, strict=True), key=lambda p: (-p[1], p[0]))
        rows.append((
            name, fitted.name, {k: str(v) for k, v in fitted.params.items()},
            float(fitted.auc_mean), float(fitted.auc_std), ranked,
        ))
    described = spark.createDataFrame(
        rows,
        "model string, model_type string, best_params map<string, string>, cv_auc_mean double, "
        "cv_auc_std double, feature_importances array<struct<feature: string, importance: double>>",
    )
    return metrics.join(F.broadcast(described), "model")


def predict(model: PipelineModel, features: DataFrame, columns: list[str] = style.FEATURES):
    """Adds ``probability`` of class 1 to a feature table."""
    scored = model.transform(style.clean_features(features, columns))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop(
        "raw_features", "features", "rawPrediction", "prediction"
    )


def predict_files(files: DataFrame, model: PipelineModel) -> DataFrame:
    """Model probability of every Python file."""
    scored = predict(model, style.style_features(files))
    return scored.select("scan_id", "file_path", F.col("probability").alias("model_probability"))


def save_model(trained: Trained, path: str) -> None:
    """Model, scaler and feature order in one pipeline."""
    trained.model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""Classifier metrics as aggregates over a predictions table.

``predictions``: model, label (0/1), probability.  A prediction is positive
from probability 0.5 up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running_totals


def _hit(label: int, predicted: int) -> Column:
    positive = (F.col("probability") >= 0.5).cast("int")
    return F.count_if((F.col("label") == label) & (positive == predicted))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(
        _hit(0, 0).alias("tn"), _hit(0, 1).alias("fp"), _hit(1, 0).alias("fn"),
        _hit(1, 1).alias("tp"),
    )


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def binary_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a ratio is undefined."""
    m = confusion_matrix(predictions)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        m.withColumn("test_samples", tn + fp + fn + tp)
        .withColumn("accuracy", _ratio(tp + tn, F.col("test_samples")))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1_score", _f1(F.col("precision"), F.col("recall")))
        .drop("tn", "fp", "fn", "tp")
    )


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Scores are combined first, so a score shared by a third of the rows is
    one row; each positive then beats the negatives below it.
    """
    by_score = predictions.groupBy("model", "probability").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
    )
    ranked = running_totals(by_score, "probability", ["neg"], ["model"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.groupBy("model").agg(
        _ratio(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc")
    )


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted."""
    m = confusion_matrix(predictions)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def row(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        p, r = _ratio(hit, hit + wrong), _ratio(hit, hit + missed)
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            _f1(p, r).alias("f1_score"),
            (hit + missed).alias("support"),
        )

    rows = m.select(
        "model",
        F.inline(F.array(row("0", tn, fn, fp), row("1", tp, fp, fn))),
    )
    measures = ["precision", "recall", "f1_score"]
    macro = rows.groupBy("model").agg(
        F.lit("macro avg").alias("class"),
        *[F.avg(c).alias(c) for c in measures],
        F.sum("support").alias("support"),
    )
    weighted = rows.groupBy("model").agg(
        F.lit("weighted avg").alias("class"),
        *[
            _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
            for c in measures
        ],
        F.sum("support").alias("support"),
    )
    return rows.unionByName(macro).unionByName(weighted)


def pick_best(metrics: DataFrame) -> DataFrame:
    """The forest only if its AUC is strictly higher.

    ``metrics`` has one row per trained model: model, roc_auc.
    """
    preference = F.when(F.col("model") == "forest", 0).otherwise(1)
    return metrics.agg(
        F.max_by("model", F.struct("roc_auc", preference)).alias("model"),
        F.max("roc_auc").alias("roc_auc"),
    )


def metrics_table(predictions: DataFrame) -> DataFrame:
    """All per-model numbers in one row, ready for ``write_metrics``."""
    return (
        binary_metrics(predictions)
        .join(roc_auc(predictions), "model")
        .join(confusion_matrix(predictions), "model")
    )

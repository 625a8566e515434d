"""Exact global ranks and running totals without a single-task window.

A window without partition keys sorts everything in one task.  Here rows are
first cut into ordered buckets; only bucket totals (a fixed number of rows)
are summed in order, and the fine order is settled inside each bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_digits(df: DataFrame) -> int:
    """Leading digits of an md5 key that cut it into 4,096 buckets, or 16 for every core if that is more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(3, len(f"{16 * cores:x}"))


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def rank_by_hash(df: DataFrame, hash_column: str, rank: str, within: list[str] | None = None):
    """Adds the 1-based rank in ``hash_column`` order, per ``within`` group.

    ``hash_column`` is a hex digest, so its leading digits cut every group,
    however large, into equal ordered buckets.
    """
    within = within or []
    bucketed = df.withColumn("_bucket", F.substring(hash_column, 1, hash_digits(df)))
    sizes = bucketed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy(*within, "_bucket").orderBy(hash_column))
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, [*within, "_bucket"])
        .withColumn(rank, (F.col("_inside") + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_inside", "_offset")
    )


def bucket_count(df: DataFrame) -> int:
    """Two buckets per shuffle partition, so buckets shrink as clusters grow."""
    return max(256, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ordered_buckets(
    df: DataFrame, order: Column, bucket: str, buckets: int | None = None
) -> DataFrame:
    """Adds ``bucket``, a number that grows with ``order``.

    Bounds are approximate quantiles of the whole table (an array of ``buckets``
    numbers on the driver), so no bucket is large however the values are distributed;
    only equal values always share one.  The lookup is a binary search.
    """
    buckets = buckets or bucket_count(df)
    steps = [i / buckets for i in range(1, buckets)]
    keyed = df.withColumn("_order", order.cast("double"))
    bounds = keyed.agg(F.percentile_approx("_order", F.lit(steps), F.lit(4 * buckets)).alias("b"))
    cuts = sorted(set(bounds.first().b or [])) or [0.0]
    splits = [float("-inf"), *cuts, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol="_order", outputCol=bucket, handleInvalid="keep")
        .transform(keyed)
        .drop("_order")
    )


def running_totals(
    df: DataFrame, order: str, values: list[str], within: list[str],
    buckets: int | None = None,
) -> DataFrame:
    """Adds ``<value>_before``: the total of all rows with a smaller ``order``.

    ``order`` must be unique within a group (aggregate ties first).
    """
    bucketed = ordered_buckets(df, F.col(order), "_bucket", buckets)
    sums = bucketed.groupBy(*within, "_bucket").agg(
        *[F.sum(v).alias(f"_{v}") for v in values]
    )
    before = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *within,
        "_bucket",
        *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values],
    )
    inner = (
        W.partitionBy(*within, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    )
    placed = bucketed.withColumns(
        {f"_in_{v}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values}
    ).join(offsets, [*within, "_bucket"])
    totals = {f"{v}_before": F.col(f"_{v}") + F.col(f"_in_{v}") for v in values}
    return placed.withColumns(totals).drop(
        "_bucket", *[f"_{v}" for v in values], *[f"_in_{v}" for v in values]
    )

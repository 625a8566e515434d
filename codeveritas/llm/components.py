"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read


def _toward_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours (all that are larger, or all of a node that is larger than they are)
    are linked to the least of the node and its neighbours instead."""
    if larger_only:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if larger_only:
        moved = both.filter("b > a").join(least, "a")
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = both.join(least, "a")
    own = least.select("a", F.col("m").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of `links` (a long, b long).

    Every round is written once to the shared folder; the rounds end when a round changes nothing,
    which takes a logarithmic number of them in practice.
    """
    links = write_and_read(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    while True:
        links = write_and_read(_toward_least(_toward_least(links, True), False), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(state)

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, built-in functions only.

Every document gets an exponential key -ln(u) / w from a uniform u (a digest of its id) and its
quality weight w; in ascending key order a source is a weighted sample without replacement.  Sizes
are prefix-summed in that order up to the source's budget.  A budget of at least the source's size
first takes every document once (a complete epoch) and the rest in key order.

Targets: the budget is shared by weight; a source stops at `most_epochs` times its size and what it
leaves is shared again by weight among the others.  With sources sorted by size / weight this is
one pass over running sums: those with the smallest ratios are full, and the first that is not
sets the rate of all others, which is the highest rate of any source that is not full.

Prefix sums of a hot source do not meet in one task: keys are dealt into slices that are about even
for each source, sums of slices are added up first, and only the rows of one slice share a window.

Defined results: null or wordless text has size 0 and is taken 0 times; the null source is a source
of its own, last; ids may repeat or be null (their rows are told apart by a digest of the text, and
equal rows share a key and are ordered as equals); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read

#: White space of the word pattern, as a Java class (fixed values).
WORD = "[^\\x20\\x09-\\x0D]+"

#: Weights of the sources in code-point order, repeating (fixed values).
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MOST_EPOCHS = 2.0

#: Rows a slice of a source holds on average.
SLICE_ROWS = 4_000


def word_count(text: Column) -> Column:
    """Words of a text: places where a word starts, counted by removing what is not one."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\x01")
    return F.length(F.regexp_replace(marked, "[\\x20\\x09-\\x0D]+", "")).cast("long")


def quality_weight(text: Column) -> Column:
    """Weight in (0, 1] of a text: its share of letters, digits and white space, squared."""
    n = F.length(F.coalesce(text, F.lit("")))
    odd = n - F.length(F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>", ""))
    share = F.when(n > 0, 1.0 - odd / n).otherwise(1.0)
    return F.greatest(share * share, F.lit(0.01))


def uniform(row: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of a string."""
    bits = F.conv(F.substring(F.md5(row), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def target_table(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> source, source_size, target.  One row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(order) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(table, (place % len(weights) + 1).cast("int")))
    cap = most * F.col("source_size")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        ranked.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", F.greatest(F.col("budget") - F.col("cap_before"), F.lit(0.0)) / F.col("weight_left"))
        .withColumn("open_rate", F.max(F.when(F.col("ratio") > F.col("rate"), F.col("rate"))).over(everything))
    )
    full = F.col("ratio") <= F.col("rate")
    return rated.select(
        "source", "source_size",
        F.when(full | F.col("open_rate").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("open_rate")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = BUDGET_SHARE,
    most_epochs: float = MOST_EPOCHS,
    seed: str = "mix",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes.

    A document is taken `floor(target / source_size)` whole times and then, in key order, while the
    words before it are fewer than the rest of the target; the last one taken is cut to fit.
    """
    text = F.col(f"`{text_col}`").cast("string")
    named = F.concat_ws(
        ":", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    )
    sized = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        quality_weight(text).alias("quality"),
        named.alias("name"),
        F.xxhash64(text).alias("tie"),
    ).withColumn("key", -F.log(uniform(F.col("name"))) / F.col("quality"))
    return take(sized, weights, share, most_epochs, slice_rows)


def take(sized: DataFrame, weights, share: float, most_epochs: float, slice_rows: int) -> DataFrame:
    """From doc_id, source, size, quality, key, tie to the words taken."""
    rows = write_and_read(sized, "mix-sizes")
    per_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("quality").alias("mean_quality")
    )
    per_source = write_and_read(per_source, "mix-sources")
    targets = target_table(per_source.select("source", "source_size"), weights, share, most_epochs)
    facts = targets.join(per_source.select("source", "n", "mean_quality"), targets["source"].eqNullSafe(per_source["source"])).select(
        targets["source"], "source_size", "target", "n", "mean_quality"
    )
    # One row a source; a join that Spark broadcasts if the table turns out small, else splits.
    joined = rows.join(facts, rows["source"].eqNullSafe(facts["source"])).select(
        rows["doc_id"], rows["source"], "size", "key", "tie", "source_size", "target", "n", "mean_quality"
    )
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / slice_rows))
    spread = 1 - F.exp(-F.col("key") * F.col("mean_quality"))
    cut = joined.withColumn("slice", F.least(slices - 1, F.floor(spread * slices)).cast("long"))
    sums = cut.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("words_ahead", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    sums = sums.select(F.col("source").alias("of"), F.col("slice").alias("part"), "words_ahead")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("words_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = ranked.join(sums, ranked["source"].eqNullSafe(sums["of"]) & (ranked["slice"] == sums["part"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    before = F.col("words_ahead") + F.col("words_inside")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )

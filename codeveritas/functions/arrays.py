"""Statistics over an array column, computed inside the row.

A source file is one row, so its statistics need no shuffle: they are array
expressions evaluated where the file was read.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used inside a lambda is re-evaluated for every element; binding
    it as a lambda argument makes it a plain variable there.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(fn):
    """Builds the expression for a column name once per driver process.

    A large expression takes thousands of driver-to-JVM calls to assemble.  It
    is immutable, so it is reused for the same bare name (``F.col(name)``); a
    column that belongs to a frame, or is computed, prints like others that it
    is not, and is built anew.
    """
    built: dict = {}

    @wraps(fn)
    def reuse(column: Column, *args) -> Column:
        node = column._jc.node()
        if node.getClass().getSimpleName() != "UnresolvedAttribute" or node.planId().isDefined():
            return fn(column, *args)
        key = (id(SparkContext._gateway), str(column), *map(str, args))
        if key not in built:
            built[key] = fn(column, *args)
        return built[key]

    return reuse


def moments(values: Column) -> Column:
    """``struct(n, s, ss)``: count, sum and sum of squares of an integer array."""
    zero = F.lit(0).cast("bigint")
    sums = F.aggregate(
        values,
        F.struct(zero.alias("s"), zero.alias("ss")),
        lambda acc, x: F.struct(
            (acc["s"] + x).alias("s"), (acc["ss"] + x.cast("bigint") * x).alias("ss")
        ),
    )
    return F.struct(
        F.size(values).cast("bigint").alias("n"), sums["s"].alias("s"), sums["ss"].alias("ss")
    )


def mean(m: Column) -> Column:
    """Mean of a ``moments`` struct, 0 when it is empty."""
    return F.when(m["n"] > 0, m["s"] / m["n"]).otherwise(F.lit(0.0))


def sample_std(m: Column) -> Column:
    """Sample deviation of a ``moments`` struct, 0 below two values.

    The numerator is exact integer arithmetic, so the result does not depend
    on the order of the values.
    """
    spread = (m["n"] * m["ss"] - m["s"] * m["s"]).cast("double")
    return F.when(
        m["n"] > 1, F.sqrt(spread / (m["n"] * (m["n"] - 1)).cast("double"))
    ).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / max(whole, 1) as a double."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def count_where(values: Column, predicate) -> Column:
    return F.size(F.filter(values, predicate))


def pairs(values: Column) -> Column:
    """Adjacent pairs of a string array, each joined to one string."""
    n = F.size(values)
    following = F.when(n > 1, F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(1))))
    leading = F.when(n > 1, F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(1))))
    joined = F.zip_with(leading, following, lambda a, b: F.concat_ws("\x1f", a, b))
    return F.coalesce(joined, F.array().cast("array<string>"))


def run_lengths(values: Column) -> Column:
    """Multiplicity of every distinct element, via one sort of the array."""
    return let(F.sort_array(values), _runs_of_sorted)


def _runs_of_sorted(ordered: Column) -> Column:
    # The last position of each run of equal elements, then the distances
    # between neighbouring ends.
    positions = F.transform(
        ordered,
        lambda x, i: F.when(~F.equal_null(x, F.get(ordered, i + 1)), i + 1),
    )
    return let(
        F.filter(positions, lambda end: end.isNotNull()),
        lambda ends: F.transform(
            ends, lambda end, k: end - F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0))
        ),
    )


def repeated_total(values: Column) -> Column:
    """Number of elements whose value occurs more than once."""
    runs = run_lengths(values)
    return F.aggregate(
        runs, F.lit(0), lambda acc, n: acc + F.when(n > 1, n).otherwise(F.lit(0))
    )


def entropy_of_counts(counts: Column, total: Column) -> Column:
    """Shannon entropy in bits of a multiplicity array; 0 for no symbols."""
    n = total.cast("double")
    weighted = F.aggregate(
        counts, F.lit(0.0), lambda acc, c: acc + c.cast("double") * F.log2(c.cast("double"))
    )
    return F.when(n > 0, F.log2(n) - weighted / n).otherwise(F.lit(0.0))


def symbol_entropy(values: Column) -> Column:
    return let(values, lambda v: entropy_of_counts(run_lengths(v), F.size(v)))

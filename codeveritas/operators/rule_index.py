"""Rule tables of any size, through an index of the literals their patterns need.

Nearly every pattern has a factor: a plain string that each of its matches contains.  Factors of a small
table form one automaton; a pass over the case-folded text tells which of them occur in which
line, and only these lines meet the rules of their factor, by a join on the factor, where the pattern
decides.  Lines never meet rules that they cannot match.  Of a larger table the automaton holds the
heads of the factors only; where one occurs, the strings of its factors' lengths are looked up by a
shuffled join, so texts are read once whatever the number of rules.  Patterns without a factor are
tried on all texts, as `rules.scan_rules` does.
"""

from __future__ import annotations

import re._constants as constants
import re._parser as parser
import sys
import warnings

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, text
from ..session import write_and_read
from . import rules
from .symbols import KEY

# Workers get these functions by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rules whose automaton and table a task holds, and heads of factors of a larger table.
BLOCK_RULES = 50_000

#: Lengths of heads, the longest that gives few enough.
HEADS = (3, 4, 6, 8, 12, 16)

#: Shortest factor worth an entry; patterns without factors that one projection tries.
LEAST_FACTOR, UNINDEXED = 3, 100

RULE = ["rule_id", "pattern", "category", "severity", "message", "fix"]
_PLACE = T.ArrayType(T.StructType([T.StructField("factor", T.IntegerType()), T.StructField("line", T.IntegerType())]))
_PLACE_ARROW = pa.struct([("factor", pa.int32()), ("line", pa.int32())])
_STRING = T.ArrayType(T.StructType([T.StructField("needs", T.StringType()), T.StructField("line", T.IntegerType())]))
_STRING_ARROW = pa.struct([("needs", pa.string()), ("line", pa.int32())])


def _runs(tokens, out: list[str], run: str) -> str:
    """Collects runs of literals that every match contains; returns the run that is still open."""
    for kind, value in tokens:
        if kind is constants.LITERAL:
            run += chr(value)
            continue
        if kind is constants.SUBPATTERN and not value[1] and not value[2]:
            run = _runs(value[3], out, run)
            continue
        if kind in (constants.MAX_REPEAT, constants.MIN_REPEAT, constants.POSSESSIVE_REPEAT) and value[0] >= 1:
            # The first copy continues the run, what follows the repeat does not.
            out.append(_runs(value[2], out, run))
            run = ""
            continue
        if kind is constants.AT or kind in (constants.ASSERT, constants.ASSERT_NOT):
            continue
        out.append(run)
        run = ""
    return run


def required_factor(pattern: str) -> str | None:
    """The longest plain ASCII string, in lower case, that every match of the pattern contains."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tokens = parser.parse(pattern)
    except Exception:  # noqa: BLE001 - a pattern of another dialect has no known factor
        return None
    if tokens.state.flags & constants.SRE_FLAG_VERBOSE:
        return None
    out: list[str] = []
    out.append(_runs(tokens, out, ""))
    pieces = [p for run in out for p in _ascii_pieces(run)]
    best = max(pieces, key=len, default="")
    return best.lower() if len(best) >= LEAST_FACTOR else None


def _ascii_pieces(run: str) -> list[str]:
    return "".join(c if c.isascii() and c != "\n" else "\n" for c in run).split("\n")


@F.pandas_udf(T.StringType())
def _factor_of(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_factor, na_action="ignore").astype(object).where(lambda s: s.notna(), None)


def _places(factors: list[str]):
    """Distinct (factor, line) of a folded text, by one pass of an automaton over the factors."""

    @F.arrow_udf(_PLACE)
    def places(texts: pa.Array) -> pa.Array:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, factor in enumerate(factors):
            automaton.add_word(factor, k)
        automaton.make_automaton()
        out = []
        for code in texts.to_pylist():
            found, line, at = set(), 0, 0
            for end, k in automaton.iter(code or ""):
                # Line breaks up to here; a factor holds none.
                line += code.count("\n", at, end)
                at = end
                found.add((k, line))
            out.append([{"factor": k, "line": n} for k, n in sorted(found, key=lambda x: (x[1], x[0]))])
        return pa.array(out, type=pa.list_(_PLACE_ARROW))

    return places


def _strings(heads: list[tuple[str, list[int]]]):
    """Distinct (string, line) of a folded text that have a head and the length of one of its factors."""

    @F.arrow_udf(_STRING)
    def strings(texts: pa.Array) -> pa.Array:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for head, lengths in heads:
            automaton.add_word(head, (len(head), lengths))
        automaton.make_automaton()
        out = []
        for code in texts.to_pylist():
            code = code or ""
            found, line, at, stop = set(), 0, 0, -1
            for end, (size, lengths) in automaton.iter(code):
                line += code.count("\n", at, end)
                at = end
                if stop < end:
                    stop = code.find("\n", end)
                    stop = len(code) if stop < 0 else stop
                start = end - size + 1
                found.update((code[start : start + n], line) for n in lengths if start + n <= stop)
            out.append([{"needs": x, "line": n} for x, n in sorted(found, key=lambda x: (x[1], x[0]))])
        return pa.array(out, type=pa.list_(_STRING_ARROW))

    return strings


def _heads(stored: DataFrame, most: int) -> list[tuple[str, list[int]]]:
    """Heads of the factors, about ``most`` or short ones, and the lengths of the factors of each."""
    needs = stored.where("needs is not null")
    counts = needs.agg(*[F.approx_count_distinct(F.substring("needs", 1, n)) for n in HEADS]).first()
    size = max([n for n, count in zip(HEADS, counts, strict=True) if count <= most], default=HEADS[0])
    rows = needs.groupBy(F.substring("needs", 1, size).alias("head")).agg(F.sort_array(F.collect_set(F.length("needs"))).alias("n"))
    return [(r.head, list(r.n)) for r in rows.orderBy("head").collect()]


def _as_findings(matched: DataFrame) -> DataFrame:
    line_no: Column = (F.col("line_no") + 1).cast("int")
    return matched.select(
        *KEY, "rule_id", "category", "severity", line_no.alias("line_start"), line_no.alias("line_end"), "message",
        F.substring(text.strip(F.col("line")), 1, rules.MAX_SNIPPET).alias("snippet"), F.col("fix").cast("string").alias("fix_suggestion"),
    )


def scan_rule_table(files: DataFrame, table: DataFrame, block_rules: int = BLOCK_RULES) -> DataFrame:
    """One row per (line, rule) match, as ``rules.scan_rules`` gives, for a rule table of any length.

    ``table`` has the columns RULE; rules without a pattern match nothing.
    """
    made = table.select(*RULE).where(F.col("pattern").isNotNull()).withColumn("needs", _factor_of("pattern"))
    stored = write_and_read(made.withColumn("java", F.concat(F.lit(text.java_regex("", ignore_case=True)), "pattern")), "rules")
    if stored.count() <= block_rules:
        factors = [r[0] for r in stored.where("needs is not null").select("needs").distinct().orderBy("needs").collect()]
        ids = files.sparkSession.createDataFrame(list(enumerate(factors)), "factor int, needs string")
        # A small table goes to every task.
        found, by, keyed = _places(factors), "factor", F.broadcast(stored.join(ids, "needs").drop("needs", "pattern"))
    else:
        factors = _heads(stored, block_rules)
        found, by, keyed = _strings(factors), "needs", stored.where("needs is not null").drop("pattern")
    out = None
    if factors:
        # No filter on the places: it would run the automaton a second time.
        placed = files.withColumn("_places", found(text.fold_case(F.col("content"))))
        cut = arrays.let(text.lines_of(F.col("content")), lambda lines: F.transform("_places", lambda p: F.struct(
            p[by].alias(by), p["line"].alias("line_no"), F.get(lines, p["line"]).alias("line"))))
        rows = placed.select(*KEY, F.inline(cut))
        out = _as_findings(rows.join(keyed, by).where(F.rlike("line", F.col("java"))))
    rest = [r.asDict() for r in stored.where("needs is null").select(*RULE).orderBy("rule_id", "pattern").collect()]
    for k in range(0, len(rest), UNINDEXED):
        some = rules.scan_rules(files, rest[k : k + UNINDEXED])
        out = some if out is None else out.unionByName(some)
    if out is None:
        return _as_findings(files.select(*KEY, *[F.lit("").alias(c) for c in RULE], F.lit(0).alias("line_no"), F.lit("").alias("line"))).limit(0)
    return out

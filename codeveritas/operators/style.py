"""Style features of Python files: one wide row per file.

``FEATURES`` is the order of the model's input vector.
"""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions.text import WS
from . import syntax
from .heuristics import LEVEL, char_entropy, with_char_level
from .symbols import KEY

# Feature names by position; None is a position the published
# vector never fills.  ``builtin_usage_count`` has no position there.
REFERENCE_SLOTS = {
    "avg_line_length": 0, "max_line_length": 1, "std_line_length": 2, "blank_line_ratio": 3,
    "avg_indentation": 4, "max_indentation": 5, "std_indentation": 6,
    "trailing_whitespace_ratio": 7,
    "ast_depth": 8, "ast_node_count": 9, "ast_unique_node_types": 10,
    "ast_branching_factor": 11, "max_nesting_depth": 12, "num_functions": 13, "num_classes": 14,
    "keyword_ratio": 15, "for_loop_ratio": 16, "while_loop_ratio": 17, "if_ratio": 18,
    "import_count": 19, "try_except_ratio": 20, "operator_diversity": 21,
    "builtin_usage_count": None,
    "cyclomatic_complexity": 22, "avg_function_complexity": 23,
    "avg_identifier_length": 24, "max_identifier_length": 25, "std_identifier_length": 26,
    "snake_case_ratio": 27, "single_char_ratio": 28, "underscore_prefix_ratio": 29,
    "identifier_entropy": 30,
    "comment_density": 31, "has_docstrings": 32, "inline_comment_ratio": 33,
    "char_entropy": 34, "token_entropy": 35, "unique_token_ratio": 36,
    "bigram_repetition_score": 37,
}
FEATURES = list(REFERENCE_SLOTS)

# The features of each group, as the structs below name them.
LINE_FIELDS = [
    "avg_line_length", "max_line_length", "std_line_length", "blank_line_ratio",
    "avg_indentation", "max_indentation", "std_indentation", "trailing_whitespace_ratio",
    "comment_density", "inline_comment_ratio",
]
TOKEN_FIELDS = [
    "keyword_ratio", "for_loop_ratio", "while_loop_ratio", "if_ratio", "try_except_ratio",
    "operator_diversity", "builtin_usage_count", "token_entropy", "unique_token_ratio",
    "bigram_repetition_score",
]
NODE_FIELDS = {
    "shape": [
        "ast_depth", "ast_node_count", "ast_unique_node_types", "ast_branching_factor",
        "max_nesting_depth", "num_functions", "num_classes", "import_count", "has_docstrings",
    ],
    "complexity": ["cyclomatic_complexity", "avg_function_complexity"],
    "naming": [
        "avg_identifier_length", "max_identifier_length", "std_identifier_length",
        "snake_case_ratio", "single_char_ratio", "underscore_prefix_ratio", "identifier_entropy",
    ],
}

FUNCTION_TYPES = ["FunctionDef", "AsyncFunctionDef"]
DOCUMENTED_TYPES = [*FUNCTION_TYPES, "ClassDef", "Module"]
BRANCH_TYPES = [
    "If", "IfExp", "For", "AsyncFor", "While", "ExceptHandler", "With", "AsyncWith", "Assert",
]
COMPREHENSION_TYPES = ["ListComp", "SetComp", "DictComp", "GeneratorExp"]
IDENTIFIER_TYPES = [*FUNCTION_TYPES, "ClassDef", "Name", "Attribute"]

KEYWORDS = keyword.kwlist
BUILTINS = [name for name in dir(builtins) if name not in keyword.kwlist]


def feature_dictionary(spark) -> DataFrame:
    """Feature name, position in our vector, position in the published one."""
    rows = [(name, i, slot) for i, (name, slot) in enumerate(REFERENCE_SLOTS.items())]
    return spark.createDataFrame(rows, "feature string, position int, reference_slot int")


@arrays.built_once
def line_features(code: Column) -> Column:
    """Lengths, indentation, blank and trailing-space shares, comments."""

    def over(parts: Column) -> Column:
        lines, solid = parts["lines"], parts["solid"]
        lengths = F.transform(lines, F.length)
        indents = F.transform(solid, lambda x: F.length(x) - F.length(text.lstrip(x)))
        measured = F.struct(
            arrays.moments(lengths).alias("len"),
            arrays.moments(indents).alias("ind"),
            F.array_max(lengths).alias("max_len"),
            F.coalesce(F.array_max(indents), F.lit(0)).alias("max_ind"),
        )
        total = F.size(lines)
        trailing = arrays.count_where(solid, lambda x: text.rstrip(x) != x)
        comments = arrays.count_where(solid, lambda x: text.lstrip(x).startswith("#"))
        inline = arrays.count_where(solid, has_inline_comment)
        return arrays.let(
            measured,
            lambda m: F.struct(
                arrays.mean(m["len"]).alias("avg_line_length"),
                m["max_len"].cast("double").alias("max_line_length"),
                arrays.sample_std(m["len"]).alias("std_line_length"),
                arrays.ratio(total - F.size(solid), total).alias("blank_line_ratio"),
                arrays.mean(m["ind"]).alias("avg_indentation"),
                m["max_ind"].cast("double").alias("max_indentation"),
                arrays.sample_std(m["ind"]).alias("std_indentation"),
                arrays.ratio(trailing, F.size(solid)).alias("trailing_whitespace_ratio"),
                arrays.ratio(comments, total).alias("comment_density"),
                arrays.ratio(inline, total).alias("inline_comment_ratio"),
            ),
        )

    split = arrays.let(
        text.lines_of(code),
        lambda lines: F.struct(
            lines.alias("lines"), F.filter(lines, lambda x: ~text.is_blank(x)).alias("solid")
        ),
    )
    return arrays.let(split, over)


def has_inline_comment(line: Column) -> Column:
    """A ``#`` outside quotes on a line that does not start with one.

    Quotes toggle regardless of kind, so everything between two of them (or
    from a last one to the end) is removed first.
    """
    unquoted = F.regexp_replace(text.strip(line), r"""['"][^'"]*(?:['"]|$)""", "")
    return line.contains("#") & ~F.rlike(line, F.lit(rf"^[{WS}]*#")) & unquoted.contains("#")


@arrays.built_once
def token_features(tokens: Column) -> Column:
    def over(t: Column) -> Column:
        texts, ops = t["texts"], t["ops"]
        n = F.size(texts)

        def share(*words: str) -> Column:
            return arrays.ratio(arrays.count_where(texts, lambda x: x.isin(*words)), n)

        repetition = arrays.let(
            arrays.pairs(texts), lambda p: arrays.ratio(arrays.repeated_total(p), F.size(p))
        )
        return F.struct(
            share(*KEYWORDS).alias("keyword_ratio"),
            share("for").alias("for_loop_ratio"),
            share("while").alias("while_loop_ratio"),
            share("if").alias("if_ratio"),
            share("try", "except").alias("try_except_ratio"),
            F.size(F.array_distinct(ops)).cast("double").alias("operator_diversity"),
            arrays.count_where(texts, lambda x: x.isin(BUILTINS)).cast("double").alias(
                "builtin_usage_count"
            ),
            arrays.symbol_entropy(texts).alias("token_entropy"),
            arrays.ratio(F.size(F.array_distinct(texts)), n).alias("unique_token_ratio"),
            repetition.alias("bigram_repetition_score"),
        )

    split = F.struct(
        F.transform(tokens, lambda t: t["text"]).alias("texts"),
        F.transform(
            F.filter(tokens, lambda t: t["kind"] == "OP"), lambda t: t["text"]
        ).alias("ops"),
    )
    return arrays.let(split, over)


def branch_weight(node: Column) -> Column:
    """Extra execution paths a node adds."""
    return (
        F.when(node["type"].isin(BRANCH_TYPES), 1)
        .when(node["type"] == "BoolOp", node["n"] - 1)
        .when(node["type"].isin(COMPREHENSION_TYPES), node["n"])
        .otherwise(0)
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _is_identifier(nodes: Column, node: Column) -> Column:
    # Positional arguments sit in the ``args`` list of a function's arguments.
    owner = F.get(nodes, F.get(nodes, node["parent"])["parent"])
    positional = (
        (node["type"] == "arg") & (node["role"] == "args") & owner["type"].isin(FUNCTION_TYPES)
    )
    excluded = node["name"].isin(KEYWORDS + BUILTINS)
    return (node["type"].isin(IDENTIFIER_TYPES) | positional) & ~excluded


def _is_docstring(nodes: Column, node: Column) -> Column:
    holder = F.get(nodes, node["parent"])
    owner = F.get(nodes, holder["parent"])
    return F.when(
        (node["type"] == "Constant") & (node["name"] == "str") & (node["role"] == "value"),
        (holder["type"] == "Expr") & (holder["role"] == "body") & (holder["idx"] == 0)
        & owner["type"].isin(DOCUMENTED_TYPES),
    ).otherwise(F.lit(False))


def _identifier_features(names: Column) -> Column:
    n = F.size(names)
    lengths = F.transform(names, F.length)
    return F.struct(
        arrays.mean(arrays.moments(lengths)).alias("avg_identifier_length"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("double").alias("max_identifier_length"),
        arrays.sample_std(arrays.moments(lengths)).alias("std_identifier_length"),
        arrays.ratio(
            arrays.count_where(names, lambda x: F.rlike(x, F.lit("^[a-z][a-z0-9_]*$"))), n
        ).alias("snake_case_ratio"),
        arrays.ratio(arrays.count_where(names, lambda x: F.length(x) == 1), n).alias(
            "single_char_ratio"
        ),
        arrays.ratio(arrays.count_where(names, lambda x: x.startswith("_")), n).alias(
            "underscore_prefix_ratio"
        ),
        char_entropy(F.array_join(names, "")).alias("identifier_entropy"),
    )


@arrays.built_once
def node_features(nodes: Column) -> Column:
    """Shape, complexity and naming from the node list; zeros when empty."""
    count = F.size(nodes)
    parents = F.size(
        F.array_distinct(
            F.transform(F.filter(nodes, lambda x: x["parent"] >= 0), lambda x: x["parent"])
        )
    )

    def highest(field: str) -> Column:
        return F.coalesce(F.array_max(F.transform(nodes, lambda x: x[field])), F.lit(0)).cast(
            "double"
        )

    def how_many(*types: str) -> Column:
        return arrays.count_where(nodes, lambda x: x["type"].isin(*types)).cast("double")

    def complexities(weights: Column) -> Column:
        # A subtree is a contiguous run of ids, so its sum is a slice sum.
        per_function = F.transform(
            F.filter(nodes, lambda x: x["type"].isin(FUNCTION_TYPES)),
            lambda f: 1 + _total(F.slice(weights, f["id"] + 1, f["last"] - f["id"] + 1)),
        )
        return F.struct(
            F.when(count > 0, 1.0 + _total(weights)).otherwise(0.0).alias(
                "cyclomatic_complexity"
            ),
            arrays.let(
                arrays.let(per_function, arrays.moments), arrays.mean
            ).alias("avg_function_complexity"),
        )

    complexity = arrays.let(F.transform(nodes, branch_weight), complexities)
    names = F.transform(
        F.filter(nodes, lambda x: _is_identifier(nodes, x)), lambda x: x["name"]
    )
    shape = F.struct(
        highest("depth").alias("ast_depth"),
        count.cast("double").alias("ast_node_count"),
        F.size(F.array_distinct(F.transform(nodes, lambda x: x["type"]))).cast("double").alias(
            "ast_unique_node_types"
        ),
        F.when(parents > 0, (count - 1) / parents).otherwise(0.0).alias("ast_branching_factor"),
        highest("nesting").alias("max_nesting_depth"),
        how_many(*FUNCTION_TYPES).alias("num_functions"),
        how_many("ClassDef").alias("num_classes"),
        how_many("Import", "ImportFrom").alias("import_count"),
        F.exists(nodes, lambda x: _is_docstring(nodes, x)).cast("double").alias("has_docstrings"),
    )
    return F.struct(
        shape.alias("shape"),
        complexity.alias("complexity"),
        arrays.let(names, _identifier_features).alias("naming"),
    )


def feature_struct(
    code: Column, tokens: Column, nodes: Column, level: Column | None = None
) -> Column:
    """The four feature groups of one text as nested structs.

    ``level`` is the text's character entropy where a column holds it; else it is derived by
    sorting, which costs more than all other features of a text that is mostly comments.
    """
    return F.struct(*_groups(code, tokens, nodes, char_entropy(code) if level is None else level))


def _groups(code: Column, tokens: Column, nodes: Column, level: Column) -> list[Column]:
    return [
        line_features(code).alias("lines"), F.when(code.isNotNull(), level).alias("char_entropy"),
        token_features(tokens).alias("token"), node_features(nodes).alias("node"),
    ]


_GROUPS = ["lines.*", "char_entropy", "token.*", "node.shape.*", "node.complexity.*", "node.naming.*"]


def style_features(files: DataFrame) -> DataFrame:
    """Feature row of every Python file.

    Blank text has all zeros; text that does not parse keeps its line and
    token features and has zeros for the syntax features.
    """
    code = F.col("code")
    parsed = with_char_level(syntax.with_syntax(files), code, F.lit(True))
    # A column for each group: Spark derives only the groups that are asked for.
    parts = parsed.select(
        *KEY, text.is_blank(code).alias("blank"),
        *_groups(code, F.col("tokens"), F.col("nodes"), F.col(LEVEL)),
    )
    flat = parts.select(*KEY, "blank", *_GROUPS)
    return flat.select(
        *KEY, *[F.when(F.col("blank"), 0.0).otherwise(F.col(f)).alias(f) for f in FEATURES]
    )


def feature_array(features: Column, names: list[str]) -> Column:
    """Clean values of a ``feature_struct`` as an array in the order of ``names``."""
    lines, token = features["lines"], features["token"]
    node = features["node"]
    fields = {
        **{n: lines[n] for n in LINE_FIELDS}, "char_entropy": features["char_entropy"],
        **{n: token[n] for n in TOKEN_FIELDS},
        **{n: node[group][n] for group, of in NODE_FIELDS.items() for n in of},
    }
    return F.array(*[_clean(fields[n]) for n in names])


def clean_features(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Null, NaN and infinite values become 0."""
    return df.withColumns({c: _clean(F.col(c)) for c in columns})


def _clean(value: Column) -> Column:
    x = value.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(x)


def features_batch(files: DataFrame) -> DataFrame:
    """Clean features of all Python files, one row each, none missing."""
    return clean_features(style_features(files))

"""Python tokens and syntax nodes as rows.

Lexing and parsing Python is the one step built-in functions cannot express.
A small Arrow UDF emits the raw token and node lists of each file; everything
computed from them is ordinary column work.
"""

from __future__ import annotations

import ast
import io
import sys
import tokenize

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import row_parts
from .symbols import KEY, is_python

# Workers get these functions by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
]))
_TEXT_FIELDS = ("type", "role", "name")
_NODE_FIELDS = (
    "id", "parent", "last", "depth", "nesting", "type", "role", "idx", "name", "n", "line",
    "start", "end",
)
NODES = T.ArrayType(T.StructType([
    T.StructField(f, T.StringType() if f in _TEXT_FIELDS else T.IntegerType())
    for f in _NODE_FIELDS
]))
_TOKEN = pa.struct([("kind", pa.string()), ("text", pa.string())])
_NODE = pa.struct(
    [(f, pa.string() if f in _TEXT_FIELDS else pa.int32()) for f in _NODE_FIELDS]
)

_NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.TryStar)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)


def _lex(code: str, out: list[list]) -> None:
    """NAME and OP tokens up to the first lexer error, appended to the columns of _TOKEN."""
    kinds, texts = out
    try:
        for tok in tokenize.generate_tokens(io.StringIO(code).readline):
            if tok.type == tokenize.NAME:
                kinds.append("NAME")
                texts.append(sys.intern(tok.string))
            elif tok.type == tokenize.OP:
                kinds.append("OP")
                texts.append(tok.string)
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass


def _label(node: ast.AST) -> str | None:
    for field in ("name", "id", "attr", "arg"):
        value = getattr(node, field, None)
        if isinstance(value, str):
            return value
    if isinstance(node, ast.Constant):
        return type(node.value).__name__
    return None


def _arity(node: ast.AST) -> int:
    if isinstance(node, ast.BoolOp):
        return len(node.values)
    if isinstance(node, _COMPREHENSIONS):
        return len(node.generators)
    if isinstance(node, ast.Call):
        return len(node.args)
    return 0


def _children(node: ast.AST) -> list[tuple[str, int, ast.AST]]:
    out = []
    for field in node._fields:
        value = getattr(node, field, None)
        if isinstance(value, ast.AST):
            out.append((field, 0, value))
        elif isinstance(value, list):
            out += [(field, i, item) for i, item in enumerate(value) if isinstance(item, ast.AST)]
    return out


def _walk(code: str, out: list[list]) -> None:
    """Nodes in pre-order, appended to the columns of _NODE; a node's subtree is the ids ``id``..``last``."""
    tree = ast.parse(code)
    offsets = [0]
    for line in code.encode("utf-8").split(b"\n"):
        offsets.append(offsets[-1] + len(line) + 1)
    ids, parents, lasts, depths, nestings, types, roles, places, names, arities, lines, starts, ends = out
    first = len(ids)
    # An explicit stack: deep expressions must not exhaust the worker's stack.
    stack = [(tree, -1, 1, 0, "", 0)]
    while stack:
        node, parent, depth, nesting, role, idx = stack.pop()
        inner = nesting + isinstance(node, _NESTING)
        line = getattr(node, "lineno", None)
        here = len(ids) - first
        ids.append(here)
        parents.append(parent)
        lasts.append(here)
        depths.append(depth)
        nestings.append(inner)
        types.append(type(node).__name__)
        roles.append(role)
        places.append(idx)
        names.append(_label(node))
        arities.append(_arity(node))
        lines.append(line)
        starts.append(None if line is None else offsets[line - 1] + node.col_offset)
        ends.append(None if line is None else offsets[node.end_lineno - 1] + node.end_col_offset)
        stack += [(child, here, depth + 1, inner, field, i) for field, i, child in reversed(_children(node))]
    for k in range(len(ids) - 1, first, -1):
        above = first + parents[k]
        if lasts[k] > lasts[above]:
            lasts[above] = lasts[k]


def _nodes(code: str, out: list[list]) -> None:
    before = len(out[0])
    try:
        _walk(code, out)
    except _PARSE_ERRORS:
        for column in out:
            del column[before:]


#: Values of a batch's lists that are Python objects at a time.
_CHUNK = 50_000


def _mapped(codes: pa.Array, fn, item: pa.DataType) -> pa.Array:
    """Lists of structs, collected by column, a chunk after the other turned into Arrow."""
    columns, made = [[] for _ in item], []
    ends, done = [0], 0

    def pack() -> None:
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, item, strict=True)]
        made.append(pa.StructArray.from_arrays(arrays, fields=list(item)))
        for c in columns:
            c.clear()

    for code in codes:
        code = code.as_py()
        if code is not None and code.strip():
            fn(code, columns)
        ends.append(done + len(columns[0]))
        if len(columns[0]) > _CHUNK:
            done = ends[-1]
            pack()
    pack()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(made))


@F.arrow_udf(TOKENS)
def python_tokens(codes: pa.Array) -> pa.Array:
    return _mapped(codes, _lex, _TOKEN)


@F.arrow_udf(NODES)
def python_nodes(codes: pa.Array) -> pa.Array:
    return _mapped(codes, _nodes, _NODE)


def with_syntax(files: DataFrame) -> DataFrame:
    """Python files with their ``tokens`` and ``nodes`` arrays."""
    return files.where(is_python()).withColumns(
        {"tokens": python_tokens("code"), "nodes": python_nodes("code")}
    )


def explode_tokens(files: DataFrame) -> DataFrame:
    """One row per NAME or OP token of a Python file."""
    return files.where(is_python()).select(
        *KEY, F.posexplode(python_tokens("code")).alias("pos", "token")
    ).select(*KEY, "pos", "token.*")


def explode_ast_nodes(files: DataFrame) -> DataFrame:
    """One row per syntax node; a file that does not parse has none."""
    return files.where(is_python()).select(*KEY, F.inline(python_nodes("code")))


def token_bigrams(tokens: DataFrame) -> DataFrame:
    """Count of every adjacent token pair per file.

    A window over one file: a file's size is capped, so no window can be big.  Files are dealt into
    a set number of parts, which the count keeps, so a task holds a small share of all tokens.
    """
    from pyspark.sql import Window as W

    following = F.lead("text").over(W.partitionBy(*KEY).orderBy("pos"))
    dealt = tokens.select(*KEY, "pos", "text").repartition(row_parts(tokens), *KEY)
    return (
        dealt.withColumn("next_text", following)
        .where(F.col("next_text").isNotNull())
        .groupBy(*KEY, "text", "next_text")
        .agg(F.count("*").alias("pairs"))
    )


def source_of(code: Column, node: Column) -> Column:
    """Source text of a node, cut out by byte offsets."""
    raw = F.encode(code, "UTF-8")
    return F.substring(raw, node["start"] + 1, node["end"] - node["start"]).cast("string")

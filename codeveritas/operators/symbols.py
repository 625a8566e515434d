"""Lines, functions, classes and imports of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions.text import WORD, WS

KEY = ["scan_id", "file_path"]

# ---------------------------------------------------------------------------
# Symbol patterns.  Group 1 is the leading whitespace; group 2
# is the rest of the match, with the captured parts inside it.
# ---------------------------------------------------------------------------

PY_FUNCTION = rf"(^[{WS}]*)((?:async[{WS}]+)?def[{WS}]+([{WORD}]+)[{WS}]*\(([^)]*)\))"
PY_CLASS = rf"^[{WS}]*class[{WS}]+[{WORD}]+"
PY_IMPORT = rf"(^[{WS}]*)((?:from[{WS}]+([{WORD}.]+)[{WS}]+)?import[{WS}]+([{WORD}., ]+))"
PY_COMMENT_LINE = rf"^[{WS}]*#"
PY_TYPE_HINT = rf":[{WS}]*[{WORD}]+|->"
JS_FUNCTION = (
    rf"()((?:async[{WS}]+)?function[{WS}]+([{WORD}]+)"
    rf"|(?:const|let|var)[{WS}]+([{WORD}]+)[{WS}]*=[{WS}]*(?:async[{WS}]+)?\()"
)
JS_CLASS = rf"^[{WS}]*(?:export[{WS}]+)?class[{WS}]+[{WORD}]+"
JS_IMPORT = (
    rf"(^[{WS}]*)(import[{WS}]+(?:\{{[^}}]+\}}[{WS}]+from[{WS}]+|[{WORD}]+[{WS}]+from[{WS}]+)?"
    rf"['\"]([^'\"]+)['\"])"
)
JS_DEFAULT = rf"^import[{WS}]+[{WORD}]+[{WS}]+from"
JS_COMMENT_LINE = rf"^[{WS}]*(?://|/\*|\*)"

# A from-import whose name list is parenthesised or starred, which the pattern
# above does not see; relative modules are left out.
PY_FROM_ANY = (
    rf"(^[{WS}]*)(from[{WS}]+([{WORD}][{WORD}.]*)[{WS}]+import[{WS}]*[(*{WORD}]|"
    rf"import[{WS}]+([{WORD}., ]+))"
)

JS_LANGUAGES = ["javascript", "typescript"]


def is_python() -> Column:
    return F.col("language") == "python"


def is_js() -> Column:
    return F.col("language").isin(JS_LANGUAGES)


def explode_lines(files: DataFrame, column: str = "content") -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(
        *KEY, F.posexplode(text.lines_of(F.col(column))).alias("pos", "line")
    ).select(*KEY, (F.col("pos") + 1).alias("line_no"), "line")


def line_profile(code: Column) -> Column:
    """Line counts and lengths of one text as a struct, inside the row."""

    def over(lines: Column) -> Column:
        lengths = F.transform(F.filter(lines, lambda x: ~text.is_blank(x)), F.length)
        return arrays.let(
            lengths,
            lambda solid: F.struct(
                F.size(lines).cast("bigint").alias("line_count"),
                (F.size(lines) - F.size(solid)).cast("bigint").alias("blank_lines"),
                arrays.mean(arrays.moments(solid)).alias("avg_line_length"),
                F.coalesce(F.array_max(solid), F.lit(0)).cast("bigint").alias("max_line_length"),
            ),
        )

    return arrays.let(text.lines_of(code), over)


def line_metrics(files: DataFrame, column: str = "code") -> DataFrame:
    return files.select(*KEY, line_profile(F.col(column)).alias("m")).select(*KEY, "m.*")


def comment_count(code: Column) -> Column:
    """Comment lines of Python, JavaScript and TypeScript files; else 0.

    A comment line may follow blank lines, which the patterns swallow, so one
    match is one comment line.
    """
    return (
        F.when(is_python(), text.count_matches(code, PY_COMMENT_LINE, multiline=True))
        .when(is_js(), text.count_matches(code, JS_COMMENT_LINE, multiline=True))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def comment_lines(files: DataFrame) -> DataFrame:
    return files.select(*KEY, comment_count(F.col("code")).alias("comment_lines"))


def class_count(code: Column) -> Column:
    return (
        F.when(is_python(), text.count_matches(code, PY_CLASS, multiline=True))
        .when(is_js(), text.count_matches(code, JS_CLASS, multiline=True))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def class_counts(files: DataFrame) -> DataFrame:
    return files.select(*KEY, class_count(F.col("code")).alias("class_count"))


def has_type_hints(code: Column) -> Column:
    return is_python() & text.matches(code, PY_TYPE_HINT)


def type_hint_flag(files: DataFrame) -> DataFrame:
    return files.select(*KEY, has_type_hints(F.col("code")).alias("has_type_hints"))


def function_total(code: Column) -> Column:
    return (
        F.when(is_python(), text.count_matches(code, PY_FUNCTION, multiline=True))
        .when(is_js(), text.count_matches(code, JS_FUNCTION, multiline=True))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def _groups(code: Column, pattern: str, *groups: int, at_match_start: bool = False) -> Column:
    """Aligned arrays (line number, captured groups) of all matches, zipped."""
    lines = text.match_lines(code, pattern, at_match_start=at_match_start, multiline=True)
    parts = [lines.alias("line_no")]
    for k in groups:
        parts.append(text.match_groups(code, pattern, k, multiline=True).alias(f"g{k}"))
    return F.arrays_zip(*parts)


def _parameter_count(params: Column) -> Column:
    named = F.filter(F.split(params, ","), lambda p: ~text.is_blank(p))
    return F.size(named)


def python_functions(files: DataFrame, at_match_start: bool = False) -> DataFrame:
    """Functions of Python files with line and parameter count."""
    found = files.where(is_python()).select(
        *KEY, F.inline(_groups(F.col("code"), PY_FUNCTION, 3, 4, at_match_start=at_match_start))
    )
    return found.select(
        *KEY,
        F.col("g3").alias("name"),
        "line_no",
        _parameter_count(F.col("g4")).alias("parameter_count"),
    )


def js_functions(files: DataFrame) -> DataFrame:
    """Functions of JavaScript and TypeScript files; parameters are not counted."""
    found = files.where(is_js()).select(
        *KEY, F.inline(_groups(F.col("code"), JS_FUNCTION, 3, 4))
    )
    name = F.concat("g3", "g4")
    return found.select(
        *KEY,
        F.when(name == "", F.lit("anonymous")).otherwise(name).alias("name"),
        "line_no",
        F.lit(0).alias("parameter_count"),
    )


def functions(files: DataFrame) -> DataFrame:
    return python_functions(files).unionByName(js_functions(files))


def function_count(files: DataFrame) -> DataFrame:
    """Functions per file, 0 included; counted in the row, without a join."""
    return files.select(*KEY, function_total(F.col("code")).alias("function_count"))


# ``is_from``: a Python ``from`` import, or a JavaScript import of a default name.
IMPORT_TYPE = "array<struct<registry:string,module:string,line_no:int,is_from:boolean>>"


def _import_row(registry: str, module: Column, line_no: Column, is_from: Column) -> Column:
    return F.struct(
        F.lit(registry).alias("registry"),
        module.alias("module"),
        line_no.alias("line_no"),
        is_from.alias("is_from"),
    )


def _plain_names(names: Column) -> Column:
    """``a, b as c`` -> [a, b]."""
    stripped = F.transform(
        F.split(names, ","), lambda p: text.strip(F.split(text.strip(p), " as ")[0])
    )
    return F.filter(stripped, lambda n: n != "")


def python_import_array(
    code: Column, accept_parenthesised: bool = False, at_match_start: bool = False
) -> Column:
    pattern = PY_FROM_ANY if accept_parenthesised else PY_IMPORT

    def rows(m: Column) -> Column:
        from_row = F.array(_import_row("pypi", m["g3"], m["line_no"], F.lit(True)))
        plain = F.transform(
            _plain_names(m["g4"]),
            lambda n: _import_row("pypi", n, m["line_no"], F.lit(False)),
        )
        return F.when(m["g3"] != "", from_row).otherwise(plain)

    found = _groups(code, pattern, 3, 4, at_match_start=at_match_start)
    return F.flatten(F.transform(found, rows)).cast(IMPORT_TYPE)


def js_import_array(code: Column) -> Column:
    return F.transform(
        _groups(code, JS_IMPORT, 2, 3),
        lambda m: _import_row("npm", m["g3"], m["line_no"], m["g2"].rlike(JS_DEFAULT)),
    ).cast(IMPORT_TYPE)


@arrays.built_once
def import_array(code: Column) -> Column:
    """Imports of one file as an array; empty for other languages."""
    return (
        F.when(is_python(), python_import_array(code))
        .when(is_js(), js_import_array(code))
        .otherwise(F.array().cast(IMPORT_TYPE))
    )


def _import_rows(files: DataFrame, imports: Column) -> DataFrame:
    return files.select(*KEY, "language", F.inline(imports)).select(
        *KEY, "language", "registry", "module", "line_no", "is_from"
    )


def python_imports(
    files: DataFrame, accept_parenthesised: bool = False, at_match_start: bool = False
) -> DataFrame:
    """Imports of Python files.

    ``accept_parenthesised`` also sees ``from m import (`` and ``*`` and skips
    relative modules; ``at_match_start`` numbers lines from the blank lines
    before an import.
    """
    found = python_import_array(F.col("code"), accept_parenthesised, at_match_start)
    return _import_rows(files.where(is_python()), found)


def js_imports(files: DataFrame) -> DataFrame:
    return _import_rows(files.where(is_js()), js_import_array(F.col("code")))


def imports(files: DataFrame) -> DataFrame:
    return _import_rows(files, import_array(F.col("code")))


def file_profile(files: DataFrame) -> DataFrame:
    """All structural metrics of a file in one pass over its text."""
    code = F.col("code")
    return files.select(
        *KEY,
        "language",
        line_profile(code).alias("m"),
        comment_count(code).alias("comment_lines"),
        class_count(code).alias("class_count"),
        function_total(code).alias("function_count"),
        F.size(import_array(code)).cast("bigint").alias("import_count"),
        has_type_hints(code).alias("has_type_hints"),
    ).select(
        *KEY, "language", "m.*", "comment_lines", "class_count", "function_count",
        "import_count", "has_type_hints",
    )

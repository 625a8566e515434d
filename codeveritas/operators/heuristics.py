"""Language-agnostic authorship heuristic: seven signals and their mix.

Every signal is an expression over the file's own row (its lines, words and
text), so scoring a corpus is a map over files without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, histograms, text
from ..functions.text import WORD, WS

# ---------------------------------------------------------------------------
# Weights, thresholds, patterns, keywords
# ---------------------------------------------------------------------------

SIGNAL_WEIGHTS = {
    "line_length_uniformity": 0.15,
    "comment_pattern": 0.20,
    "naming_regularity": 0.15,
    "entropy_signal": 0.15,
    "structural_regularity": 0.15,
    "boilerplate_ratio": 0.10,
    "docstring_density": 0.10,
}

DIVIDER = rf"[#/][{WS}]*[-─═=]{{3,}}"
STEP = rf"[#/]{{1,2}}[{WS}]*(?:Step|Phase|Stage)[{WS}]*\p{{Nd}}"
COMMENT_START = rf"^[{WS}]*(?:#|//|/\*|\*)"
DESCRIPTIVE = (
    rf"[#/]{{1,2}}[{WS}]*(?:This function|This method|This class|Initialize|Create|Return|"
    r"Check if|Validate|Ensure|Handle|Process)"
)
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]+$"
CAMEL = r"^[a-z]+[A-Z]"
BOILERPLATE = [
    rf"try[{WS}]*\{{[\s\S]*?\}}[{WS}]*catch",
    rf"if[{WS}]*\(.*?===?[{WS}]*null",
    r"(?:console\.log|print|logger)",
    r"(?:TODO|FIXME|HACK|NOTE):",
    r"(?:@param|@returns?|@throws)",
    r"(?:Args:|Returns:|Raises:)",
    rf"(?:export[{WS}]+default|module\.exports)",
]
TYPE_ANNOTATION = (
    rf":[{WS}]*(?:str|int|float|bool|list|dict|Optional|List|Dict|Tuple|string|number|boolean|"
    rf"Array|Record|Promise|void|any)(?![{WORD}])"
)
FUNCTION_HINT = (
    rf"(?:def |function |async function |const [{WORD}]+ = (?:async )?\(|"
    rf"(?:public|private|protected)[{WS}]+[{WORD}]+[{WS}]*\()"
)
# What must be in the case-folded text for a boilerplate pattern to match, and
# whether that already settles it.
BOILERPLATE_LITERALS = [
    (["catch"], False),
    (["null"], False),
    (["console.log", "print", "logger"], True),
    (["todo:", "fixme:", "hack:", "note:"], True),
    (["@param", "@return", "@throws"], True),
    (["args:", "returns:", "raises:"], True),
    (["export", "module.exports"], False),
]
FUNCTION_LITERALS = ["def ", "function ", "const ", "public", "private", "protected"]
COMMON_KEYWORDS = [
    "if", "else", "for", "while", "return", "function", "class", "def", "var", "let", "const",
    "new", "this", "self", "import", "from", "export", "default", "true", "false", "null",
    "undefined", "None", "True", "False", "try", "catch", "except", "finally", "throw", "raise",
    "async", "await", "yield", "break", "continue", "switch", "case", "public", "private",
    "protected", "static", "void", "int", "string", "bool", "float", "double", "long", "char",
    "byte", "extends", "implements", "interface", "abstract", "final", "override", "package",
    "struct", "enum", "type", "typeof", "instanceof",
]


def _steps(value: Column, bounds: list[tuple[float, float]], otherwise: float, *, below: bool):
    """First matching score of a threshold ladder; the value is computed once."""

    def ladder(v: Column) -> Column:
        out = F.lit(otherwise)
        for bound, score in reversed(bounds):
            out = F.when(v < bound if below else v > bound, score).otherwise(out)
        return out

    return arrays.let(value, ladder)


def _uniformity(solid: Column, lengths: Column) -> Column:
    average = arrays.mean(lengths)
    variation = arrays.sample_std(lengths) / average
    scored = _steps(
        variation, [(0.25, 0.85), (0.40, 0.65), (0.55, 0.45), (0.70, 0.30)], 0.15, below=True
    )
    return F.when((F.size(solid) < 5) | (average == 0), 0.5).otherwise(scored)


def _comment_pattern(lines: Column) -> Column:
    total = F.size(lines)
    # Every pattern below needs one of these characters.
    remarks = F.filter(lines, lambda x: text.contains_any(x, ["#", "/", "*"]))

    def score(c: Column) -> Column:
        share = c["comments"] / F.greatest(total, F.lit(1))
        has_divider = c["dividers"] > 0
        has_steps = c["steps"] >= 2
        moderate = (share > 0.12) & (share < 0.35)
        heavy = share > 0.35
        descriptive = c["described"] >= 3
        points = (
            F.when(
                has_divider,
                F.least(F.lit(1.0), c["dividers"] / F.greatest(total * 0.02, F.lit(1.0))) * 0.8,
            ).otherwise(0.0)
            + F.when(has_steps, 0.7).otherwise(0.0)
            + F.when(moderate, 0.5).when(heavy, 0.3).otherwise(0.0)
            + F.when(descriptive, F.least(F.lit(1.0), c["described"] / F.lit(5)) * 0.6).otherwise(
                0.0
            )
        )
        fired = (
            has_divider.cast("int")
            + has_steps.cast("int")
            + (moderate | heavy).cast("int")
            + descriptive.cast("int")
        )
        return F.when(fired > 0, F.least(F.lit(1.0), points / fired)).otherwise(0.3)

    def counts(found: Column) -> Column:
        def counted(pattern: str, **flags: bool) -> Column:
            return arrays.count_where(found, lambda x: text.matches(x, pattern, **flags))

        return F.struct(
            counted(DIVIDER).alias("dividers"),
            counted(STEP, ignore_case=True).alias("steps"),
            counted(COMMENT_START).alias("comments"),
            counted(DESCRIPTIVE, ignore_case=True).alias("described"),
        )

    return arrays.let(arrays.let(remarks, counts), score)


def _word_counts(words: Column) -> Column:
    """The fields of ``histograms.WORD_COUNTS`` by array functions."""
    # A word run is an identifier when it is ASCII, longer than one character
    # and does not start with a digit.
    names = F.filter(
        words,
        lambda w: (F.length(w) > 1) & (F.octet_length(w) == F.length(w)) & (F.ascii(w) > 57)
        & ~w.isin(COMMON_KEYWORDS),
    )

    def counts(ids: Column) -> Column:
        return F.struct(
            F.size(words).alias("words"),
            F.size(F.array_distinct(words)).alias("distinct"),
            arrays.let(arrays.pairs(words), arrays.repeated_total).alias("repeated"),
            F.size(ids).alias("names"),
            arrays.moments(F.transform(ids, F.length))["s"].alias("letters"),
            arrays.count_where(ids, lambda w: F.length(w) <= 2).alias("short"),
            arrays.count_where(ids, lambda w: w.contains("_") & (w == F.lower(w))).alias("snake"),
            arrays.count_where(ids, _is_camel).alias("camel"),
        )

    return arrays.let(names, counts)


def _naming(counts: Column) -> Column:
    n = counts["names"].cast("double")
    average = F.when(n > 0, counts["letters"] / n).otherwise(0.0)
    points = (
        _steps(average, [(10, 0.7), (7, 0.5), (5, 0.3)], 0.0, below=False)
        + _steps(counts["short"] / n, [(0.05, 0.6), (0.15, 0.3)], 0.0, below=True)
        + _steps(
            F.greatest(counts["snake"] / n, counts["camel"] / n), [(0.6, 0.5), (0.4, 0.3)], 0.0,
            below=False,
        )
    )
    return F.when(n < 10, 0.5).otherwise(F.least(F.lit(1.0), points / 1.8))


def _is_camel(word: Column) -> Column:
    return F.ascii(word).between(97, 122) & (word != F.lower(word)) & F.rlike(word, F.lit(CAMEL))


@arrays.built_once
def char_entropy(code: Column) -> Column:
    """Shannon entropy over code points.

    Sorting groups equal characters; one regex then cuts the runs, so only
    distinct characters are visited one by one.
    """
    ordered = F.array_join(F.sort_array(text.characters_of(code)), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    return arrays.entropy_of_counts(F.transform(runs, F.length), F.length(code))


def _entropy(code: Column, counts: Column, level: Column) -> Column:
    n = counts["words"]
    distinct = counts["distinct"] / n
    repeated = counts["repeated"] / F.greatest(n - 1, F.lit(1))
    points = (
        _steps(distinct, [(0.30, 0.7), (0.45, 0.5), (0.55, 0.3)], 0.0, below=True)
        + _steps(repeated, [(0.5, 0.6), (0.3, 0.4), (0.15, 0.2)], 0.0, below=False)
        + arrays.let(level, lambda e: F.when((e > 3.5) & (e < 5.0), 0.3).otherwise(0.0))
    )
    return F.when((F.length(code) < 100) | (n == 0), 0.5).otherwise(
        F.least(F.lit(1.0), points / 1.6)
    )


def _structure(lines: Column, solid: Column) -> Column:
    indents = arrays.moments(
        F.transform(solid, lambda x: F.length(x) - F.length(text.lstrip(x)))
    )
    blank_at = F.filter(
        F.transform(lines, lambda x, i: F.when(text.is_blank(x), i)), lambda i: i.isNotNull()
    )
    gaps = arrays.let(
        blank_at,
        lambda at: F.filter(
            F.transform(at, lambda p, k: F.when(k > 0, p - F.get(at, k - 1))),
            lambda g: g.isNotNull(),
        ),
    )

    def score(m: Column) -> Column:
        # Two gaps or more mean at least three blank lines.
        regular = F.when(
            m["gaps"]["n"] >= 2, 1.0 / (1.0 + arrays.sample_std(m["gaps"]))
        ).otherwise(0.5)
        indent_std = arrays.sample_std(m["indents"])
        points = _steps(regular, [(0.3, 0.5), (0.15, 0.3)], 0.0, below=False) + (
            F.when((indent_std < 3.0) & (arrays.mean(m["indents"]) > 1.0), 0.5)
            .when(indent_std < 5.0, 0.3)
            .otherwise(0.0)
        )
        return F.least(F.lit(1.0), points)

    measured = F.struct(indents.alias("indents"), arrays.moments(gaps).alias("gaps"))
    return F.when((F.size(lines) < 10) | (F.size(solid) < 5), 0.5).otherwise(
        arrays.let(measured, score)
    )


def _boilerplate(code: Column) -> Column:
    def hits(folded: Column) -> Column:
        found = F.lit(0)
        for pattern, (literals, settled) in zip(BOILERPLATE, BOILERPLATE_LITERALS, strict=True):
            hit = text.contains_any(folded, literals)
            if not settled:
                hit = hit & text.matches(code, pattern, ignore_case=True)
            found = found + hit.cast("int")
        return found

    share = arrays.let(text.fold_case(code), hits) / len(BOILERPLATE)
    return _steps(share, [(0.5, 0.7), (0.3, 0.5), (0.15, 0.35)], 0.2, below=False)


def _documentation(code: Column, line_count: Column) -> Column:
    quotes = text.count_literal(code, '"""') + text.count_literal(code, "'''")
    blocks = F.floor(quotes / 2) + text.count_literal(code, "/**")
    functions = F.when(
        text.contains_any(code, FUNCTION_LITERALS), text.count_matches(code, FUNCTION_HINT)
    ).otherwise(0)
    annotations = F.when(
        code.contains(":"), text.count_matches(code, TYPE_ANNOTATION)
    ).otherwise(0)
    per_function = blocks / F.greatest(functions, F.lit(1))
    hints = annotations / F.greatest(line_count, F.lit(1))
    points = _steps(per_function, [(0.8, 0.7), (0.4, 0.4)], 0.0, below=False) + _steps(
        hints, [(0.05, 0.5), (0.02, 0.3)], 0.0, below=False
    )
    return F.least(F.lit(1.0), points / 1.2)


@arrays.built_once
def signals(code: Column, level: Column | None = None, counts: Column | None = None) -> Column:
    """The seven signals of one text as a struct of doubles.

    ``level`` is the text's character entropy and ``counts`` its word counts where
    columns hold them (``with_text_counts``); else they are derived here, by sorting.
    """
    level = char_entropy(code) if level is None else level
    counts = arrays.let(text.words_of(code), _word_counts) if counts is None else counts

    def over(parts: Column) -> Column:
        lines, solid, counts = parts["lines"], parts["solid"], parts["counts"]
        lengths = arrays.moments(F.transform(solid, F.length))
        return F.struct(
            arrays.let(lengths, lambda m: _uniformity(solid, m)).alias("line_length_uniformity"),
            _comment_pattern(lines).alias("comment_pattern"),
            _naming(counts).alias("naming_regularity"),
            _entropy(code, counts, level).alias("entropy_signal"),
            _structure(lines, solid).alias("structural_regularity"),
            _boilerplate(code).alias("boilerplate_ratio"),
            _documentation(code, F.size(lines)).alias("docstring_density"),
        )

    def split(lines: Column) -> Column:
        return F.struct(
            lines.alias("lines"),
            F.filter(lines, lambda x: ~text.is_blank(x)).alias("solid"),
            counts.alias("counts"),
        )

    return arrays.let(arrays.let(text.lines_of(code), split), over)


def mix(s: Column) -> Column:
    """Weighted sum of a signals struct, clamped to 0..1."""
    total = sum((s[name] * weight for name, weight in SIGNAL_WEIGHTS.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


LEVEL = "char_level"
COUNTS = "word_counts"


def with_char_level(files: DataFrame, code: Column, needed: Column) -> DataFrame:
    """Adds the character entropy of the texts that need it, from histograms of Arrow batches."""
    return files.withColumn(LEVEL, histograms.char_entropy(F.when(needed, code)))


def with_text_counts(files: DataFrame, code: Column, needed: Column) -> DataFrame:
    """Adds the word counts of the texts that need them, from histograms of Arrow batches."""
    count = histograms.word_counts(COMMON_KEYWORDS)
    # One string crosses to the worker faster than an array of strings.
    lines = F.array_join(text.words_of(F.when(needed, code)), "\n")
    return files.withColumn(COUNTS, count(F.nullif(lines, F.lit(""))))


def heuristic_signals(files: DataFrame, column: str = "code") -> DataFrame:
    """Adds ``signals``; null for blank text, which has none."""
    code = F.col(column)
    solid = ~text.is_blank(code)
    counted = with_text_counts(with_char_level(files, code, solid), code, solid)
    found = F.when(solid, signals(code, F.col(LEVEL), F.col(COUNTS)))
    return counted.withColumn("signals", found).drop(LEVEL, COUNTS)


def heuristic_score(files: DataFrame, column: str = "code") -> DataFrame:
    """Adds ``signals`` and ``ai_probability`` (0.5 for blank text)."""
    scored = heuristic_signals(files, column)
    return scored.withColumn(
        "ai_probability",
        F.when(F.col("signals").isNotNull(), mix(F.col("signals"))).otherwise(0.5),
    )

"""Text semantics shared by every operator.

The scores are defined on Python's text rules (Unicode whitespace, ``\\n`` as
the only line break, code points as characters).  Everything that depends on
those rules lives here so no operator spells them out again.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "            "
    "    　"
)

# The same set, and Python's ``\w``, as regex class bodies (use inside ``[]``).
# Both bodies mean the same in Java and in RE2.
WS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"

WORD_RUN = f"[{WORD}]+"

# Marks the position of a regex match inside a text; never part of real text
# because ``normalise`` removes it.
MARK = "\x01"
STAND_IN = "\x02"


def java_regex(pattern: str, *, ignore_case: bool = False, multiline: bool = False) -> str:
    """Prefix a pattern with the flags that give it Python's meaning.

    ``d`` makes ``\\n`` the only line break, ``iu`` folds case over Unicode.
    """
    flags = "d" + ("iu" if ignore_case else "") + ("m" if multiline else "")
    return f"(?{flags}){pattern}"


def matches(col: Column, pattern: str, **flags: bool) -> Column:
    return F.rlike(col, F.lit(java_regex(pattern, **flags)))


def count_matches(col: Column, pattern: str, **flags: bool) -> Column:
    return F.regexp_count(col, F.lit(java_regex(pattern, **flags)))


def count_literal(col: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    gone = F.length(col) - F.length(F.replace(col, F.lit(literal), F.lit("")))
    return F.floor(gone / F.lit(len(literal))).cast("bigint")


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITESPACE))


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    # From the left: it ends at the first other character.
    return lstrip(col) == F.lit("")


def lines_of(col: Column) -> Column:
    """All lines, trailing empty ones included; empty text has one line."""
    return F.split(col, "\n", -1)


def words_of(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD_RUN), F.lit(0))


def characters_of(col: Column) -> Column:
    """One element per code point; an empty array for empty text."""
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, ""))


def normalise(col: Column) -> Column:
    """Lenient UTF-8 and ``\\n`` newlines.

    Accepts a binary or a string column.
    """
    text = F.make_valid_utf8(col.cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n")


# Characters that case-insensitive matching treats as the ASCII letter beside
# them although lower-casing does not.
FOLDED = {"ſ": "s", "İ": "i", "ı": "i", "K": "k"}


def fold_case(col: Column) -> Column:
    """Lower case such that an ASCII literal is contained exactly when the
    original contains it under case-insensitive matching."""
    for char, letter in FOLDED.items():
        col = F.replace(col, F.lit(char), F.lit(letter))
    return F.lower(col)


def contains_any(col: Column, literals: Iterable[str]) -> Column:
    return reduce(or_, [col.contains(x) for x in literals])


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """Lower-cased last suffix of the file name; a leading dot is no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def match_lines(
    col: Column, pattern: str, *, at_match_start: bool = False, **flags: bool
) -> Column:
    """1-based line number of every match, in match order.

    The pattern's first group is its leading whitespace and the second its
    rest.  The number is the keyword's line; with ``at_match_start`` it is the
    line where the whitespace begins, which may be a blank line further up.
    """
    mark = f"{MARK}$0" if at_match_start else f"$1{MARK}$2"
    # The marker must not occur in the text: in this copy, which only counts
    # lines, another control character stands for it.
    marked = F.regexp_replace(F.translate(col, MARK, STAND_IN), java_regex(pattern, **flags), mark)
    per_line = F.transform(
        lines_of(marked),
        lambda line, i: F.array_repeat(i + 1, F.size(F.split(line, MARK, -1)) - 1),
    )
    return F.flatten(per_line)


def match_groups(col: Column, pattern: str, group: int, **flags: bool) -> Column:
    return F.regexp_extract_all(col, F.lit(java_regex(pattern, **flags)), F.lit(group))

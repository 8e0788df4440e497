"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN = "Unknown"

# Texts that stand for a missing category.
EMPTY_MARKS = ["", "nan", "None", "NaT"]
EMPTY_MARKS_UPPER = ["", "NAN", "NONE", "NAT", "UNKNOWN"]


# The characters that count as white space, ASCII and beyond.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: str | Column) -> Column:
    """Strip all white space, including NBSP and tabs, from both ends."""
    return F.btrim(as_column(col).cast("string"), F.lit(WHITE_SPACE))


def drop_ws(col: str | Column) -> Column:
    return F.translate(as_column(col).cast("string"), WHITE_SPACE, "")


def unless_in(col: Column, marks: list[str]) -> Column:
    """The text, or ``Unknown`` if it is NULL or one of the marks."""
    return F.when(col.isNull() | col.isin(marks), F.lit(UNKNOWN)).otherwise(col)


def unknown_if_empty(col: str | Column) -> Column:
    """Trimmed text; null and (case-sensitive) empty marks become ``Unknown``."""
    return unless_in(strip_ws(col), EMPTY_MARKS)


def blank_to_unknown(col: str | Column) -> Column:
    """Trimmed text; only null and the empty text become ``Unknown``."""
    return unless_in(strip_ws(col), [""])


def category(col: str | Column) -> Column:
    """Trimmed text; empty marks in any case become ``Unknown``."""
    text = strip_ws(col)
    return F.when(text.isNull() | F.upper(text).isin(EMPTY_MARKS_UPPER), F.lit(UNKNOWN)).otherwise(text)


def plan_code(col: str | Column) -> Column:
    """Upper-case plan or lot code; inner spaces stay."""
    return unless_in(F.upper(strip_ws(col)), EMPTY_MARKS_UPPER)


def fold(col: str | Column) -> Column:
    """Comparable text: trimmed and lower case, null as the empty text."""
    return F.coalesce(F.lower(strip_ws(col)), F.lit(""))


def fold_spaces(col: str | Column) -> Column:
    """Like ``fold``, with runs of white space as one space."""
    return F.regexp_replace(F.translate(fold(col), WHITE_SPACE, " " * len(WHITE_SPACE)), " +", " ")


def street_name(col: str | Column) -> Column:
    """Upper-case words of letters and digits, separated by single spaces."""
    words = F.regexp_replace(F.upper(as_column(col).cast("string")), "[^A-Z0-9]+", " ")
    return F.coalesce(F.trim(words), F.lit(""))


def pair_key(first: str | Column, second: str | Column) -> Column:
    """``first__second``, blanks as ``Unknown``."""
    return F.concat_ws("__", blank_to_unknown(first), blank_to_unknown(second))


def base_feature(col: str | Column) -> Column:
    """The name after the first ``__``, or the whole name."""
    return F.regexp_replace(as_column(col), r"^.*?__", "")

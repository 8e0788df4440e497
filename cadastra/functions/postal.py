"""Canadian postal codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cadastra.functions.text import EMPTY_MARKS_UPPER, UNKNOWN, as_column, drop_ws, strip_ws, unless_in

# Full code, its first three characters, and a code inside free text.
POSTAL_PATTERN = r"^[A-Z]\d[A-Z]\d[A-Z]\d$"
FSA_PATTERN = r"^[A-Z]\d[A-Z]"
POSTAL_IN_TEXT = r"\b([A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d)\b"


def postal_code(col: str | Column, drop_dashes: bool = False) -> Column:
    """Stored form: upper case without white space, empty marks as ``Unknown``."""
    text = F.upper(drop_ws(col))
    if drop_dashes:
        text = F.regexp_replace(text, "-", "")
    return unless_in(text, EMPTY_MARKS_UPPER)


def lookup_postal(col: str | Column) -> Column:
    """Form used for matching requests: no spaces or dashes, null as the empty text."""
    return F.coalesce(F.regexp_replace(F.upper(strip_ws(col)), "[ -]", ""), F.lit(""))


def postal_fsa(postal: str | Column) -> Column:
    """First three characters of a stored code, ``Unknown`` if they have another shape."""
    postal = as_column(postal)
    return F.when(postal.rlike(FSA_PATTERN), F.substring(postal, 1, 3)).otherwise(F.lit(UNKNOWN))


def lookup_fsa(col: str | Column) -> Column:
    postal = lookup_postal(col)
    return F.when(F.length(postal) >= 3, F.substring(postal, 1, 3)).otherwise(F.lit(""))


def is_valid_postal(col: str | Column) -> Column:
    return postal_code(col).rlike(POSTAL_PATTERN)


def postal_in_text(col: str | Column) -> Column:
    """First postal code found inside a free text, or NULL."""
    found = F.regexp_extract(as_column(col), POSTAL_IN_TEXT, 1)
    return F.when(found != "", F.upper(F.regexp_replace(found, "[ -]", "")))

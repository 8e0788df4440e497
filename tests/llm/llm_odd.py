"""Rows that every operator must bear."""

from __future__ import annotations

#: Nulls, empty and blank texts, white space, a long text, ties, a repeated row and missing ids.
ODD = [
    (1, "a b  c"), (2, "a b\tc"), (3, None), (4, ""), (5, " "), (6, "word " * 30_000), (7, "é \U0001f642 x"), (7, "é \U0001f642 x"), (8, "one"), (None, "no id"), (None, None),
]

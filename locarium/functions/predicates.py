"""Blank, missing and valid: several definitions, kept apart on purpose.

They differ by where a value is used; each takes a column or its name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that the checker takes for blank, trimmed and in lower case. A parameter.
CHECKER_BLANKS = ("", "n/a", "none")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_value(x) -> Column:
    """For display (F10): not null, not blank when trimmed, not starting with the word N/A."""
    return F.coalesce((F.trim(_c(x)) != "") & ~_c(x).rlike(r"^(?i)\s*n/a\b"), F.lit(False))


def checker_blank(x, blanks=CHECKER_BLANKS) -> Column:
    """For the checker (F10): null, or one of a few values when trimmed and in lower case."""
    return _c(x).isNull() | F.lower(F.trim(_c(x))).isin(*blanks)


def merge_blank(x) -> Column:
    """For merging (F10): null or exactly the empty text; N/A isn't blank here."""
    return _c(x).isNull() | (_c(x).cast("string") == "")


def required_missing(x) -> Column:
    """For validation: nothing is left when trimmed."""
    return F.coalesce(F.trim(_c(x).cast("string")), F.lit("")) == ""


def has_coordinates(lat="lat", lon="lon") -> Column:
    """Both coordinates are there (F9); blank coordinates are NULL throughout."""
    return _c(lat).isNotNull() & _c(lon).isNotNull()


def named_flag(x, word: str) -> Column:
    """Whether a word stands in a name (F8), in any case."""
    return F.coalesce(_c(x).rlike(rf"(?i)\b{word}\b"), F.lit(False))

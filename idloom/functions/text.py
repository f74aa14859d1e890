"""Text normalisation shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that trimming removes: space, tab, line feed, carriage return.
BLANKS = " \t\n\r"
#: Texts that stand for null after trimming and lower-casing.
NULL_TEXTS = ("", "null", "none")


def trim_all(c: Column) -> Column:
    """Remove spaces, tabs and line ends on both sides."""
    return F.regexp_replace(c, r"\A[ \t\n\r]+|[ \t\n\r]+\z", "")


def norm_text(c: Column) -> Column:
    """Trimmed lower-case text; null where the text is null-like."""
    t = F.lower(trim_all(c))
    return F.when(~t.isin(*NULL_TEXTS), t)


def micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a zone-less timestamp (the session zone is UTC)."""
    return F.unix_micros(c.cast("timestamp"))

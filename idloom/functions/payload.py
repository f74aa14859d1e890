"""JSON payload columns as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload(raw: Column) -> Column:
    """The payload as a variant; null where the text is null, empty or not complete JSON.

    A payload that is itself a JSON string holding an object's JSON text counts as that object.
    """
    outer = F.try_parse_json(raw)
    inner = F.try_parse_json(F.try_variant_get(outer, "$", "string"))
    return F.when(F.regexp_like(raw, F.lit(r'\A[ \t\n\r]*"')), inner).otherwise(outer)


def get_text(v: Column, path: str) -> Column:
    """A scalar of a variant as text, whether written as string or number; null where it is missing or null."""
    return F.try_variant_get(v, path, "string")

"""JSON access by dotted paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path types and the SQL types they are read as.
TYPES = {"string": "string", "int": "bigint", "integer": "bigint", "bigint": "bigint", "float": "double", "double": "double", "number": "decimal(38,0)", "boolean": "boolean", "timestamp": "timestamp", "date": "date"}


def json_path(v: Column, path: str, kind: str | None = None) -> Column:
    """A value of a variant at ``a.b[0].c``; null where it is missing or not of the kind. Untyped: its JSON text."""
    full = "$" + ("" if path.startswith("[") else ".") + path
    if kind is None:
        return F.to_json(F.try_variant_get(v, full, "variant"))
    return F.try_variant_get(v, full, TYPES[kind])


def header(headers: Column, name: str) -> Column:
    """The value of the first of ``headers`` (array of variants {name, value}) with that name, in any letter case."""
    hit = F.filter(headers, lambda h: F.lower(F.try_variant_get(h, "$.name", "string")) == name.lower())
    return F.try_variant_get(F.get(hit, F.lit(0)), "$.value", "string")

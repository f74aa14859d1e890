"""Dates, times and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format letters of the warehouse dialect and Spark's.
FORMAT_LETTERS = (("YYYY", "yyyy"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"))


def spark_format(fmt: str) -> str:
    for a, b in FORMAT_LETTERS:
        fmt = fmt.replace(a, b)
    return fmt


def convert_timezone(c: Column, target: str, source: str = "UTC") -> Column:
    """Wall clock of ``target`` for a wall clock of ``source``."""
    return F.convert_timezone(F.lit(source), F.lit(target), c)


def try_date(c: Column, fmt: str | None = None) -> Column:
    return F.try_to_date(c, spark_format(fmt)) if fmt else c.try_cast("date")


def try_timestamp(c: Column, fmt: str | None = None) -> Column:
    t = F.try_to_timestamp(c, F.lit(spark_format(fmt))) if fmt else c.try_cast("timestamp")
    return t.cast("timestamp_ntz")


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c).cast("timestamp_ntz")


def from_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def interval_seconds(c: Column) -> Column:
    """Seconds of an ``HH:MM:SS`` duration; null where it is none."""
    t = F.when(F.regexp_like(c, F.lit(r"\A\s*[-+]?\d+:\d+:\d+\s*\z")), c)
    return F.try_element_at(F.split(t, ":"), F.lit(1)).try_cast("bigint") * 3600 + F.try_element_at(F.split(t, ":"), F.lit(2)).try_cast("bigint") * 60 + F.try_element_at(F.split(t, ":"), F.lit(3)).try_cast("bigint")


def try_interval(name: str) -> Column:
    """try_cast of the column ``name`` to an interval hour to second."""
    return F.expr(f"try_cast(`{name}` as interval hour to second)")


def iso_utc(c: Column) -> Column:
    """An ISO-8601 text with offset as UTC wall clock; null on failure."""
    return c.try_cast("timestamp").cast("timestamp_ntz")

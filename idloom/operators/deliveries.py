"""Messages delivered more than once: exactly one copy of each stays.

Identifiers that are producer sequences (decimal numbers, and 64-bit numbers in hexadecimal) are tracked as disjoint
seen ranges per producer; every other identifier is malformed in that sense and resolved by an exact keyed lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom.storage import cut

#: Last digits of a decimal identifier that count within its producer; the digits before them name the producer.
SEQUENCE_DIGITS = 9
#: Digits of a hexadecimal identifier, and how many of them name the producer.
HEX_DIGITS, HEX_PRODUCER = 16, 4
#: Numbers of one range chunk. It bounds the rows of one window group, whatever the producer's size.
CHUNK = 1 << 16

RANGE_SCHEMA = "producer string, chunk bigint, lo bigint, hi bigint"


def sequence_parts(key: Column) -> tuple[Column, Column]:
    """(producer, number) of a producer-sequence identifier, else (null, null); different identifiers differ in them.

    Sixteen lower-case hexadecimal digits: ``x`` and the first four name the producer, the other 48 bits count. Ten to
    thirty decimal digits without a leading zero (but not sixteen): ``d`` and all but the last nine name the producer.
    """
    hexa = F.regexp_like(key, F.lit(rf"\A[0-9a-f]{{{HEX_DIGITS}}}\z"))
    good = F.regexp_like(key, F.lit(r"\A[1-9][0-9]{9,29}\z"))
    at = F.length(key) - SEQUENCE_DIGITS
    producer = F.when(hexa, F.concat(F.lit("x"), F.substring(key, 1, HEX_PRODUCER))).when(good, F.concat(F.lit("d"), F.substring(key, F.lit(1), at)))
    number = F.when(hexa, F.conv(F.substring(key, HEX_PRODUCER + 1, HEX_DIGITS - HEX_PRODUCER), 16, 10).cast("bigint")).when(good, F.substring(key, at + 1, F.lit(SEQUENCE_DIGITS)).cast("bigint"))
    return producer, number


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Merge overlapping or touching ranges (producer, chunk, lo, hi) within each chunk."""
    w = Window.partitionBy("producer", "chunk").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranges.withColumn("_new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("producer", "chunk", "_run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("producer", "chunk", "lo", "hi")
    )


def uncovered(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``numbers`` (producer, chunk, number, ...) that no range covers.

    A running maximum over ranges and numbers of one chunk finds coverage without a range join.
    """
    rest = [c for c in numbers.columns if c not in ("producer", "chunk", "number")]
    a = numbers.select("producer", "chunk", F.col("number").alias("_pos"), F.lit(None).cast("bigint").alias("_hi"), F.lit(1).alias("_kind"), *rest)
    b = ranges.select("producer", "chunk", F.col("lo").alias("_pos"), F.col("hi").alias("_hi"), F.lit(0).alias("_kind"), *[F.lit(None).cast(numbers.schema[c].dataType).alias(c) for c in rest])
    w = Window.partitionBy("producer", "chunk").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        a.unionByName(b)
        .withColumn("_reach", F.max("_hi").over(w))
        .where((F.col("_kind") == 1) & (F.col("_reach").isNull() | (F.col("_reach") < F.col("_pos"))))
        .select("producer", "chunk", F.col("_pos").alias("number"), *rest)
    )


def accept(batch: DataFrame, ranges: DataFrame, known: DataFrame) -> DataFrame:
    """Accept one delivery batch against the state of the batches before it.

    batch: (row_id, ts, key, producer, number); producer and number are null for malformed identifiers. ranges: the seen
    ranges. known: keys of malformed identifiers seen so far. Returns one row (row_id, key, producer, chunk, number) for
    each identifier not seen yet: that of the latest ``ts`` (null is earliest), then the greatest ``row_id``. Copies within
    the batch are reduced map-side to the one of them that may be accepted, so an identifier with a third of all rows
    sends one row a task.
    """
    latest = F.max(F.struct("ts", "row_id", "key")).alias("best")
    numbers = batch.where("producer is not null").groupBy("producer", "number").agg(latest)
    numbers = numbers.select("producer", F.expr(f"number div {CHUNK}").alias("chunk"), "number", "best.row_id", "best.key")
    others = batch.where("producer is null").groupBy("key").agg(F.max(F.struct("ts", "row_id")).alias("best")).join(known, "key", "left_anti")
    return (
        uncovered(numbers, ranges).select("row_id", "key", "producer", "chunk", "number")
        .unionByName(others.select("best.row_id", "key", F.lit(None).cast("string").alias("producer"), F.lit(None).cast("bigint").alias("chunk"), F.lit(None).cast("bigint").alias("number")))
    )


class Deliveries:
    """What one run over all batches gives: ``accepted`` (row_id, key, producer), ``ranges`` and ``rows``, every keyed row."""

    def __init__(self, accepted: DataFrame, ranges: DataFrame, rows: DataFrame):
        self.accepted, self.ranges, self.rows = accepted, ranges, rows


def take_batches(df: DataFrame, row_id: str, key: str, ts: str, batches: int = 2) -> Deliveries:
    """One row of each key is accepted.

    The rows are taken as delivery batches, newest first, so that a key's first acceptance is its latest row. Batches
    are cut at quantiles of ``ts``; rows of equal ``ts`` share a batch; null ``ts`` is earliest. Rows with a null key take
    no part. The source is read once.
    """
    spark = df.sparkSession
    producer, number = sequence_parts(F.col("key"))
    keyed = df.where(F.col(key).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(ts).alias("ts"), F.col(key).alias("key"))
    rows = cut(keyed.withColumns({"producer": producer, "number": number})).df
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    at = rows.agg(F.percentile_approx(us, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted({*(at or [])}, reverse=True)
    ranges = spark.createDataFrame([], RANGE_SCHEMA)
    known = spark.createDataFrame([], "key string")
    out = None
    for i in range(len(cuts) + 1):
        newer = us < cuts[i - 1] if i else F.lit(True)
        part = rows.where((newer & (us >= cuts[i])) if i < len(cuts) else (F.coalesce(newer, F.lit(True)) if i else F.lit(True)))
        got = cut(accept(part, ranges, known)).df
        numbers = got.where(F.col("producer").isNotNull())
        new_ranges = numbers.select("producer", "chunk", F.col("number").alias("lo"), F.col("number").alias("hi"))
        ranges = merge_ranges(ranges.unionByName(new_ranges))
        if i < len(cuts):
            ranges = cut(ranges).df
        known = known.unionByName(got.where(F.col("producer").isNull()).select("key"))
        out = got if out is None else out.unionByName(got)
    return Deliveries(out.select("row_id", "key", "producer"), ranges, rows)


def surplus_rows(df: DataFrame, row_id: str, key: str, ts: str, batches: int = 2) -> DataFrame:
    """The ``row_id`` of every row with a key that is not the one kept.

    ``row_id`` is unique, so the last anti-join spreads evenly even where one key holds most rows.
    """
    d = take_batches(df, row_id, key, ts, batches)
    return d.rows.select("row_id").join(d.accepted.select("row_id"), "row_id", "left_anti").select(F.col("row_id").alias(row_id))

"""Carrying values forward along time, however many rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block of time: what one task sorts of one key.
BLOCK_US = 7 * 86_400_000_000


def carry_last(df: DataFrame, keys: list[str], time: str, order: list[str], values: list[str], inclusive: bool = True, block_us: int = BLOCK_US) -> DataFrame:
    """Adds ``_last_<value>`` for each of ``values``: the last one that isn't null among the key's rows up to this one (before
    this one, unless ``inclusive``) by (time, order). Rows need a time and keys.

    Rows are sorted within blocks of time only, so a key with a third of all rows is spread over its blocks. What goes
    from block to block is one row a key and block, reduced map-side, and just these are carried along the whole key.
    """
    b = df.withColumn("_blk", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(block_us)).cast("bigint"))
    upto = Window.partitionBy(*keys, "_blk").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = b.select("*", *[F.last(v, ignorenulls=True).over(upto).alias("_in_" + v) for v in values])
    ends = b.groupBy(*keys, "_blk").agg(*[F.max(F.when(F.col(v).isNotNull(), F.struct(time, *order, F.col(v).alias("_v"))))["_v"].alias("_end_" + v) for v in values])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_blk", *[F.last("_end_" + v, ignorenulls=True).over(before).alias("_old_" + v) for v in values])
    out = within.join(carried, [*keys, "_blk"], "left")
    return out.select(*df.columns, *[F.coalesce("_in_" + v, "_old_" + v).alias("_last_" + v) for v in values])

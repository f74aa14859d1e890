"""Joins that stay even where one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.storage import cut

#: A label carried by more rows than this is joined in salted parts of about so many rows.
HOT_ROWS = 500_000


def join_label(rows: DataFrame, labels: DataFrame, key: str, size: str, spread_by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` left-joined with one row of ``labels`` per key, hot keys in parts.

    ``labels`` counts in ``size`` the rows that carry each key. A key over ``hot_rows`` is repeated once for each part and
    its rows are spread over the parts by a hash of ``spread_by``, so a task run again places every row as before. The
    list of such keys is at most rows / hot_rows long, whatever the data (two million short rows at 10^12), and is all that
    is broadcast.
    """
    parts = F.ceil(F.col(size) / hot_rows).cast("int")
    hot = labels.where(F.col(size) > hot_rows).select(F.col(key), parts.alias("_parts"))
    many = labels.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(size)
    part = F.coalesce(F.pmod(F.xxhash64(F.col(spread_by), F.lit(7)), F.col("_parts")).cast("int"), F.lit(0))
    spread = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part).drop("_parts")
    return spread.join(many, [key, "_part"], "left").drop("_part")


def join_even(rows: DataFrame, labels: DataFrame, key: str, spread_by: str, hot_rows: int = HOT_ROWS, at_most: int | None = None) -> DataFrame:
    """``rows`` left-joined with one row of ``labels`` per key, whatever the keys' sizes; ``rows`` should be a written table.

    ``at_most``: a bound on the rows, if the caller knows one. The keys with more than ``hot_rows`` rows are counted first, map-side. If there is none, nearly always, the join is a
    plain one; else their rows are spread as in ``join_label``. Both plans give the same rows.
    """
    if (rows.limit(hot_rows + 1).count() if at_most is None else at_most) <= hot_rows:
        return rows.join(labels, key, "left")  # too few rows for a hot key
    sizes = rows.groupBy(key).agg(F.count("*").alias("_size")).where(F.col("_size") > hot_rows)
    hot = cut(sizes).df
    if hot.isEmpty():
        return rows.join(labels, key, "left")
    return join_label(rows, labels.join(F.broadcast(hot), key, "left").fillna(1, ["_size"]), key, "_size", spread_by, hot_rows)

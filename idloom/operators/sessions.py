"""Sessions of activity: maximal runs of a key's events whose inner gaps stay within a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of one merging block (with 30-minute cells about 85 days).
BLOCK_CELLS = 4096


def _merge(parts: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Merge partial sessions (start_us, end_us, n_events) of equal keys whose boundary gap is at most ``gap_us``."""
    w = Window.partitionBy(*keys).orderBy("start_us")
    return (
        parts.withColumn("_new", F.when(F.col("start_us") - F.lag("end_us").over(w) <= gap_us, 0).otherwise(1))
        .withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_no")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"))
    )


def sessionize(events: DataFrame, key: str, us: str, gap_us: int, event_id: str | None = None) -> DataFrame:
    """(key, start_us, end_us, n_events, duration_us): one row per session.

    Time is divided into cells as long as the gap: all events of a key in one cell are one partial session, built by a
    map-side aggregate, so a key with a third of all rows is spread and shrunk before it is shuffled. Partial sessions
    are merged within blocks of cells; only a block's first and last one can go on in a neighbour, and just these are
    merged per key, so no task holds more rows of a key than it has blocks (cells, within a block).

    Rows with a null key or time take no part. Rows with equal ``event_id`` count once (the earliest time, then the
    least key, where copies differ); null event ids are events of their own. A gap equal to the limit does not end a
    session. No rows give no sessions.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(us).isNotNull()).select(F.col(key).alias("_k"), F.col(us).alias("_us"), *([F.col(event_id).alias("_e")] if event_id else []))
    if event_id:
        once = rows.where("_e is not null").groupBy("_e").agg(F.min(F.struct("_us", "_k")).alias("_m")).select("_m._k", "_m._us")
        rows = once.unionByName(rows.where("_e is null").select("_k", "_us"))
    cells = (
        rows.withColumn("_cell", F.expr(f"(_us - pmod(_us, {gap_us}L)) div {gap_us}L"))
        .groupBy("_k", "_cell")
        .agg(F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.count("*").alias("n_events"))
        .withColumn("_block", F.expr(f"(_cell - pmod(_cell, {BLOCK_CELLS}L)) div {BLOCK_CELLS}L"))
    )
    local = _merge(cells, ["_k", "_block"], gap_us)
    w = Window.partitionBy("_k", "_block")
    local = local.withColumn("_edge", (F.col("_no") == F.min("_no").over(w)) | (F.col("_no") == F.max("_no").over(w)))
    cols = ["_k", "start_us", "end_us", "n_events"]
    whole = local.where(~F.col("_edge")).select(*cols)
    joined = _merge(local.where("_edge"), ["_k"], gap_us).select(*cols)
    return whole.unionByName(joined).select(F.col("_k").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")

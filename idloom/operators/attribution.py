"""Marketing attribution over touchpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.operators.relational import empty
from idloom.operators.timeline import carry_last

WINDOW_DAYS = 90


def touchpoint_paths(touchpoints: DataFrame, participants: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """The last touchpoint at or before each event, within a window of calendar days: one path per event.

    Consecutive touchpoints of an entity with one deduplication key count as the first. Ties go to the least touchpoint_id,
    entity type and entity. The as-of step carries the last touch time forward on one line per entity.
    """
    t = touchpoints.select("touchpoint_id", "touchpoint_event_id", "attribution_deduplication_key", F.col("occurred_at").alias("_t")).join(participants.select(F.col("event_id").alias("touchpoint_event_id"), "entity_id", "entity_type").distinct(), "touchpoint_event_id")
    key = "attribution_deduplication_key"
    t = carry_last(t.where("_t is not null"), ["entity_id", "entity_type"], "_t", ["touchpoint_id"], [key], inclusive=False)
    t = t.where(F.col("_last_" + key).isNull() | (F.col("_last_" + key) != F.col(key))).drop("_last_" + key)
    ev = participants.select("event_id", "entity_id", "entity_type", "occurred_at").where("occurred_at is not null").distinct()
    a = ev.select("entity_id", "entity_type", F.col("occurred_at").alias("_t"), F.lit(1).alias("_k"), "event_id", F.lit(None).cast("timestamp_ntz").alias("_touch"))
    b = t.select("entity_id", "entity_type", "_t", F.lit(0).alias("_k"), F.lit(None).cast("string").alias("event_id"), F.col("_t").alias("_touch")).distinct()
    line = carry_last(a.unionByName(b), ["entity_id", "entity_type"], "_t", ["_k"], ["_touch"]).withColumnRenamed("_last__touch", "_last")
    hit = line.where("_k = 1 and _last is not null").where(F.datediff("_t", "_last") <= window_days)
    hit = hit.select("entity_id", "entity_type", "event_id", F.col("_t").alias("event_occurred_at"), F.col("_last").alias("_t"))
    j = hit.join(t, ["entity_id", "entity_type", "_t"])
    rest = ["touchpoint_event_id", "attribution_deduplication_key", F.col("_t").alias("touchpoint_occurred_at"), "event_occurred_at"]
    one = j.groupBy("event_id").agg(F.min(F.struct("touchpoint_id", "entity_type", "entity_id", *rest)).alias("m")).select("event_id", "m.*")
    return one.select(
        make_id("touchpoint_path", "event_id", "entity_id", "entity_type", "touchpoint_id").alias("touchpoint_path_id"), make_id("touchpoint_path_batch", "touchpoint_id", "entity_id", "entity_type").alias("touchpoint_batch_id"),
        F.col("touchpoint_id").alias("last_touchpoint_id"), "event_id", "entity_id", "entity_type", "touchpoint_event_id", "attribution_deduplication_key", "touchpoint_occurred_at", "event_occurred_at",
    )


def path_batches(paths: DataFrame, touchpoints: DataFrame) -> DataFrame:
    """One row per batch (touchpoint and entity) with its touchpoint's attributes and its number of events."""
    g = paths.groupBy("touchpoint_batch_id", F.col("last_touchpoint_id").alias("touchpoint_id"), "entity_id", "entity_type").agg(F.count("*").alias("events_in_batch"), F.min("event_occurred_at").alias("first_event_at"), F.max("event_occurred_at").alias("last_event_at"))
    return g.join(touchpoints, "touchpoint_id")


def _result(df: DataFrame, model: str) -> DataFrame:
    return df.withColumn("attribution_model_name", F.lit(model)).withColumn("attribution_model_result_id", make_id("attribution_model_result", F.lit(model), "touchpoint_batch_id", "attributed_event_id", "entity_id"))


def _web(batches: DataFrame) -> DataFrame:
    """The web touches of persons."""
    return batches.where((F.col("entity_type") == "person") & (F.col("touchpoint_type") == "web"))


def first_touch(batches: DataFrame, participants: DataFrame) -> DataFrame:
    """The earliest web touch of each person for every event of theirs at or after it; tied touches each count, squared as in
    the model this follows (the set of first touches is joined with itself); the square is a count, not a join."""
    b = _web(batches).select("entity_id", "touchpoint_batch_id", "occurred_at", "source", "medium", "campaign", "channel")
    start = b.groupBy("entity_id").agg(F.min("occurred_at").alias("occurred_at"))
    tied = b.join(start, ["entity_id", "occurred_at"])
    ties = tied.groupBy("entity_id").agg(F.count("*").cast("int").alias("_ties"))
    twice = tied.join(ties, "entity_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_ties"))).drop("_ties", "_copy")
    ev = participants.where(F.col("entity_type") == "person").select("entity_id", F.col("event_id").alias("attributed_event_id"), F.col("occurred_at").alias("attributed_event_occurred_at")).distinct()
    return _result(twice.join(ev, "entity_id").where("attributed_event_occurred_at >= occurred_at").withColumnRenamed("occurred_at", "touchpoint_occurred_at"), "first_marketing_touch")


def last_touch(batches: DataFrame, participants: DataFrame) -> DataFrame:
    """The latest web touch at or before each event, one row per event (ties: greatest time, then batch and entity)."""
    b = _web(batches).select("entity_id", F.struct(F.col("occurred_at").alias("t"), F.col("touchpoint_batch_id").alias("b"), "source", "medium", "campaign", "channel").alias("_b"), F.col("occurred_at").alias("_t"))
    ev = participants.where(F.col("entity_type") == "person").select("entity_id", F.col("event_id").alias("attributed_event_id"), F.col("occurred_at").alias("_t")).where("_t is not null").distinct()
    line = b.groupBy("entity_id", "_t").agg(F.max("_b").alias("_b")).withColumn("_k", F.lit(0)).withColumn("attributed_event_id", F.lit(None).cast("string"))
    line = line.unionByName(ev.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    hit = carry_last(line.where("_t is not null"), ["entity_id"], "_t", ["_k"], ["_b"]).withColumnRenamed("_last__b", "_m").where("_k = 1 and _m is not null")
    one = hit.groupBy("attributed_event_id").agg(F.max(F.struct("_m", "entity_id", "_t")).alias("x"))
    out = one.select(F.col("x.entity_id").alias("entity_id"), F.col("x._m.t").alias("touchpoint_occurred_at"), F.col("x._m.b").alias("touchpoint_batch_id"), *[F.col(f"x._m.{c}").alias(c) for c in ("source", "medium", "campaign", "channel")], "attributed_event_id", F.col("x._t").alias("attributed_event_occurred_at"))
    return _result(out, "last_marketing_touch")


def last_click_id(batches: DataFrame, paths: DataFrame, column: str, value: Column | None = None) -> DataFrame:
    """The last known click id of an entity at each of its batches, given to the batches' events."""
    b = batches.withColumn("_click", value if value is not None else F.nullif(F.col(column), F.lit("")))
    b = carry_last(b, ["entity_id", "entity_type"], "occurred_at", ["touchpoint_id"], ["_click"]).withColumnRenamed("_last__click", "_last").select("touchpoint_batch_id", "entity_id", "entity_type", "_last")
    p = paths.join(b, ["touchpoint_batch_id", "entity_id", "entity_type"]).where("_last is not null")
    p = p.select("touchpoint_batch_id", "entity_id", "entity_type", "touchpoint_occurred_at", F.col("event_id").alias("attributed_event_id"), F.col("event_occurred_at").alias("attributed_event_occurred_at"), F.col("_last").alias(column))
    return _result(p, f"last_{column}")


def channel_groupings(results: DataFrame, groupings: dict[str, Column | str]) -> DataFrame:
    """One row per (grouping, result), from a single scan."""
    cells = [F.struct(F.lit(n).alias("channel_grouping"), (F.expr(e) if isinstance(e, str) else e).cast("string").alias("channel_value")) for n, e in groupings.items()]
    return results.select("*", F.inline(F.array(*cells)))


#: The columns of a touchpoint and their types, for the empty union.
TOUCHPOINT = {c: "string" for c in ("touchpoint_id", "touchpoint_event_id", "event_name", "event_type", "source", "medium", "campaign", "content", "term", "channel", "landing_page", "referrer", "landing_url", "fbclid", "gclid", "ttclid", "li_fat_id", "attribution_deduplication_key", "touchpoint_type")} | {"occurred_at": "timestamp_ntz"}


def union_touchpoints(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """All sources' touchpoints by name, missing columns null; without a source an empty table with the contract's columns."""
    if not parts:
        return empty(spark, ", ".join(f"{c} {t}" for c, t in TOUCHPOINT.items()))
    return union_results(parts)


def union_results(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

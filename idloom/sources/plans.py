"""Versioned plans delivered as JSON (tracking plans, semantic layers): latest version and exploded entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.functions.payload import get_text, payload
from idloom.operators.relational import latest


def versions(raw: DataFrame, slug: str = "plan_slug", body: str = "plan") -> DataFrame:
    """The latest row of each (organization, slug) with the number of its versions and when it was first seen."""
    p = raw.withColumn("_p", payload(F.col("_raw_record")))
    p = p.select(get_text(F.col("_p"), "$.organization_id").alias("organization_id"), get_text(F.col("_p"), f"$.{slug}").alias("slug"), get_text(F.col("_p"), "$.content_hash").alias("content_hash"), F.to_json(F.try_variant_get("_p", f"$.{body}", "variant")).alias("body"), "_ingested_at", "_row_id")
    p = p.where("organization_id is not null and slug is not null")
    stats = p.groupBy("organization_id", "slug").agg(F.count("*").alias("deliveries"), F.count_distinct("content_hash").alias("version_count"), F.min("_ingested_at").alias("first_seen_at"))
    return latest(p, ["organization_id", "slug"], ["_ingested_at", "_row_id"]).join(stats, ["organization_id", "slug"])


def entries(latest_plans: DataFrame, field: str, columns: list[str]) -> DataFrame:
    """One row per entry of a list of the plan, with its position from 0."""
    e = latest_plans.select("organization_id", "slug", F.posexplode(F.try_variant_get(F.try_parse_json("body"), f"$.{field}", "array<variant>")).alias("position", "_e"))
    return e.select("organization_id", "slug", F.col("position").cast("bigint").alias("position"), *[F.try_variant_get("_e", f"$.{c}", "string").alias(c) for c in columns])

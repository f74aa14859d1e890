"""Self-describing metadata, quality monitors and exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.functions.normalize import label_of
from idloom.operators.relational import latest, union_or_empty


def events_metadata(events: DataFrame, source_columns: dict[str, DataFrame] | None = None) -> DataFrame:
    """Seen range and count of each kind of event, with the columns of its source table as JSON where given."""
    g = events.groupBy("event_name", "event_type", "source", "source_table").agg(F.min("occurred_at").alias("first_seen_at"), F.max("occurred_at").alias("last_seen_at"), F.count("*").alias("event_count"))
    if not source_columns:
        return g
    rows = [(t, json.dumps([{"name": n, "type": k} for n, k in d.dtypes])) for t, d in source_columns.items()]
    # One row per source table.
    return g.join(F.broadcast(events.sparkSession.createDataFrame(rows, "source_table string, columns_json string")), "source_table", "left")


def dimensions_metadata(dims: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Counts and the three most frequent values of each dimension, full-joined with a catalog (dimension_name, label)."""
    counts = dims.groupBy("dimension_name", "dimension_value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dimension_name").orderBy(F.col("n").desc(), F.col("dimension_value").asc_nulls_last())
    top = counts.where("dimension_value is not null").withColumn("k", F.row_number().over(w)).where("k <= 3")
    ex = top.groupBy("dimension_name").agg(*[F.max(F.when(F.col("k") == i, F.col("dimension_value"))).alias(f"example_{i}") for i in (1, 2, 3)])
    stats = counts.groupBy("dimension_name").agg(F.sum("n").alias("row_count"), F.count("dimension_value").alias("distinct_values")).join(ex, "dimension_name", "left")
    if catalog is None:
        return stats.withColumn("label", label_of(F.col("dimension_name")))
    c = catalog.select("dimension_name", F.col("label").alias("_label"))
    return stats.join(c, "dimension_name", "full").withColumn("label", F.coalesce("_label", label_of(F.col("dimension_name")))).drop("_label").fillna(0, ["row_count", "distinct_values"])


def measurements_metadata(ms: DataFrame) -> DataFrame:
    return ms.groupBy("measurement_name", "value_unit", "source").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"), F.count("value").alias("value_count"))


def traits_metadata(traits: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Distinct traits of each entity type, with the type of their column among the entities."""
    t = traits.select("entity_type", "trait_name").distinct()
    if entities is None:
        return t
    kinds = entities.sparkSession.createDataFrame(list(entities.dtypes), "_c string, column_type string")
    return t.withColumn("_c", F.replace(F.lower("trait_name"), F.lit(" "), F.lit("_"))).join(F.broadcast(kinds), "_c", "left").drop("_c")


def identifiers_metadata(identifiers: DataFrame) -> DataFrame:
    return identifiers.select("entity_type", "identifier_type").distinct()


def relationships_metadata(rel: DataFrame) -> DataFrame:
    return rel.select("relationship_type", "relationship_direction", "entity_a_type", "entity_b_type").distinct()


def sources_metadata(config: DataFrame, events: DataFrame) -> DataFrame:
    """Configured sources (source, enabled) full-joined with the freshness of their events."""
    g = events.groupBy("source").agg(F.min("occurred_at").alias("first_event_at"), F.max("occurred_at").alias("last_event_at"), F.max("_ingested_at").alias("last_ingested_at"), F.count("*").alias("event_count"))
    return config.join(g, "source", "full").withColumn("enabled", F.coalesce("enabled", F.lit(False))).fillna(0, ["event_count"])


def states_metadata(states: DataFrame) -> DataFrame:
    """Value counts, possible values and numeric range of each state."""
    by = states.groupBy("state_name", "entity_type", "state_category", "state_value").agg(F.count("*").alias("n"), F.min("state_numeric_value").alias("lo"), F.max("state_numeric_value").alias("hi"))
    return by.groupBy("state_name", "entity_type", "state_category").agg(F.sum("n").alias("row_count"), F.count("state_value").alias("distinct_values"), F.array_sort(F.collect_set("state_value")).alias("possible_values"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"))


def attribution_metadata(results: DataFrame, fields: list[str]) -> DataFrame:
    """(model, field) pairs where the field is ever set, in one scan."""
    named = F.explode(F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields])))
    return results.select("attribution_model_name", named.alias("attribution_field")).distinct()


def metrics_metadata(layers: DataFrame) -> DataFrame:
    """(organization_id, layer_slug, metric columns): the metrics of the latest layer. layers: variant ``layer``, ``_at``, ``_row_id``."""
    top = latest(layers.select("organization_id", "layer_slug", "_at", "_row_id", F.to_json("layer").alias("_json")), ["organization_id", "layer_slug"], ["_at", "_row_id"])
    m = top.select("organization_id", "layer_slug", F.posexplode(F.try_variant_get(F.try_parse_json("_json"), "$.metrics", "array<variant>")).alias("position", "_m"))
    return m.select("organization_id", "layer_slug", F.col("position").cast("bigint").alias("position"), *[F.try_variant_get("_m", f"$.{c}", "string").alias("metric_" + c) for c in ("name", "label", "type", "expr")])


def edge_distributions(edges: DataFrame, critical: int = 50, error: int = 20, warning: int = 10) -> DataFrame:
    """Identifiers with more distinct neighbours than the warning threshold: neighbour types, sources and severity."""
    a = ["entity_type_a", "identifier_type_a", "identifier_value_a"]
    n = edges.groupBy(*a).agg(F.count_distinct("identifier_value_b").alias("connections"), F.array_join(F.array_sort(F.collect_set("identifier_type_b")), ", ").alias("connected_types"))
    n = n.where(F.col("connections") > warning)
    per = edges.join(n.select(*a), a, "left_semi").groupBy(*a, "source").agg(F.count_distinct("identifier_value_b").alias("k"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.coalesce("source", F.lit("unknown")).alias("s")))), lambda x: F.concat(x.s, F.lit(" ("), (-x.k).cast("string"), F.lit(")"))), ", ")
    sources = per.groupBy(*a).agg(text.alias("source_distribution"))
    sev = F.when(F.col("connections") > critical, "CRITICAL").when(F.col("connections") > error, "ERROR").otherwise("WARNING")
    return n.join(sources, a).withColumn("severity", sev)


def format_anomaly(df: DataFrame, monitor: str, dimensions: list[str], measures: list[str], occurred_at: str, granularity: str = "day") -> DataFrame:
    """Monitor rows as anomalies: dimensions, measures and z-scores packed as JSON."""
    key = F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dimensions])
    pack = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return df.select(
        make_id("detection", F.lit(monitor), key, occurred_at).alias("detection_id"), F.lit(monitor).alias("monitor_name"), key.alias("dimension_key"), F.col(occurred_at).alias("occurred_at"), F.lit(granularity).alias("granularity"),
        pack(dimensions).alias("dimensions"), pack(measures).alias("measures"), pack([m + "_z" for m in measures]).alias("z_scores"), "max_abs_z",
    )


#: The contract of anomaly rows.
ANOMALY = "detection_id string, monitor_name string, dimension_key string, occurred_at timestamp_ntz, granularity string, dimensions string, measures string, z_scores string, max_abs_z double"


def union_anomalies(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """The detections of all monitors that are on; a typed empty table without one."""
    return union_or_empty(parts, spark, ANOMALY)


def identify_export(entities: DataFrame, entity_type: str = "person", user_id: str = "user_id", anonymous_id: str | None = None, dedupe_on: str = "email", ignore: list[str] = (), rename: dict[str, str] | None = None, filters: list[Column | str] = ()) -> DataFrame:
    """Entities as identify calls: userId, anonymousId, timestamp and traits; one row per lower-case trimmed key, the
    latest updated (unknown times last, then the greatest entity_id). Rows with a null key collapse into one."""
    rename = {"_created_at": "created_at", **(rename or {})}
    e = entities.where(F.col("entity_type") == entity_type).where(F.col(user_id).isNotNull() | (F.col(anonymous_id).isNotNull() if anonymous_id else F.lit(False)))
    for f in filters:
        e = e.where(F.expr(f) if isinstance(f, str) else f)
    e = latest(e.withColumn("_key", F.lower(F.trim(dedupe_on))), ["_key"], ["_updated_at", "entity_id"])
    skip = {"entity_id", "entity_type", "_key", "_updated_at", user_id, anonymous_id, *ignore}
    return e.select(F.col(user_id).alias("userId"), (F.col(anonymous_id) if anonymous_id else F.lit(None).cast("string")).alias("anonymousId"), F.col("_updated_at").alias("timestamp"), *[F.col(c).alias(rename.get(c, c)) for c in e.columns if c not in skip])

"""The test tables in the shape of the engine's contracts; each has the same definition in SQL (``plans.sql``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.operators.eventlog import EVENT, conform
from idloom.operators.relational import union_aligned


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _raw_events(spark, sf) -> DataFrame:
    e = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("eid", make_id("event", "event_id"))
    return e.withColumn("user_id", F.col("user_id").cast("string"))


def web_events(spark, sf) -> DataFrame:
    e = _raw_events(spark, sf)
    return conform(e.select(F.col("eid").alias("event_id"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("event_name"), F.concat("event_type", F.lit(" event")).alias("event_description"), F.lit("web").alias("event_type"), F.when(F.col("event_type") == "purchase", 10.0).otherwise(0.0).alias("significance"), F.lit("web").alias("source"), F.lit("events").alias("source_table"), F.col("ts").alias("_ingested_at")), EVENT)


def order_events(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    return conform(o.select(make_id("event", F.lit("order"), "o_orderkey").alias("event_id"), F.col("o_orderdate").alias("occurred_at"), F.lit("order placed").alias("event_name"), F.lit("order").alias("event_type"), F.lit(5.0).alias("significance"), F.lit("orders").alias("source"), F.lit("orders").alias("source_table"), F.col("o_orderdate").alias("_ingested_at")), EVENT)


def _ids(df: DataFrame, event, kind: str, value, entity: str, role: str, source: str, at: str) -> DataFrame:
    v, e = value.cast("string"), event
    return df.select(
        make_id("entity_identifier", e, v, F.lit(kind)).alias("entity_identifier_id"), e.alias("event_id"), e.alias("edge_id"), F.lit(entity).alias("entity_type"), F.lit(kind).alias("identifier_type"), v.alias("identifier_value"),
        F.lit(role).alias("role"), F.lit(source).alias("source"), F.col(at).alias("occurred_at"), F.col(at).alias("_ingested_at"),
    )


def web_identifiers(spark, sf) -> DataFrame:
    e = _raw_events(spark, sf)
    x = F.col("eid")
    anon = F.concat(F.lit("anon-"), "user_id", F.lit("-"), (F.col("k") % 3).cast("string"))
    mail = F.concat(F.lit("user"), (F.col("user_id").cast("bigint") % 50).cast("string"), F.lit("@shop.test"))
    return union_aligned([_ids(e, x, "user_id", F.col("user_id"), "person", "visitor", "web", "ts"), _ids(e, x, "anonymous_id", anon, "person", "visitor", "web", "ts"), _ids(e.where("event_type = 'signup' and k < 5"), x, "email", mail, "person", "visitor", "web", "ts")])


def noisy_identifiers(spark, sf) -> DataFrame:
    e = _raw_events(spark, sf).where("event_type = 'error'")
    return web_identifiers(spark, sf).unionByName(_ids(e, F.col("eid"), "device", F.concat(F.lit("dev-"), F.col("k").cast("string")), "person", "visitor", "web", "ts"))


def customers(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"))
    c = read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.coalesce("first_at", F.lit("1990-01-01").cast("timestamp_ntz")).alias("at"), make_id("event", F.lit("customer"), "c_custkey").alias("eid"))


def customer_identifiers(spark, sf) -> DataFrame:
    c, x = customers(spark, sf), F.col("eid")
    return union_aligned([_ids(c, x, "customer_key", F.col("c_custkey"), "person", "customer", "crm", "at"), _ids(c, x, "name", F.col("c_name"), "person", "customer", "crm", "at"), _ids(c, x, "nation_key", F.col("c_nationkey"), "group", "nation", "crm", "at")])


def customer_traits(spark, sf) -> DataFrame:
    c = customers(spark, sf)
    one = lambda n, v: c.select(make_id("entity_trait", "eid", F.lit(n)).alias("entity_trait_id"), F.col("eid").alias("event_id"), F.lit("person").alias("entity_type"), F.lit("customer_key").alias("identifier_type"), F.col("c_custkey").cast("string").alias("identifier_value"), F.lit(n).alias("trait_name"), F.col(v).alias("trait_value"), F.lit("crm").alias("source"), F.col("at").alias("occurred_at"))
    return one("name", "c_name").unionByName(one("Market Segment", "c_mktsegment"))


def all_events(spark, sf) -> DataFrame:
    c = customers(spark, sf).select(F.col("eid").alias("event_id"), F.col("at").alias("occurred_at"), F.lit("customer created").alias("event_name"), F.lit("crm").alias("event_type"), F.lit(1.0).alias("significance"), F.lit("crm").alias("source"), F.lit("customer").alias("source_table"), F.col("at").alias("_ingested_at"))
    return union_aligned([web_events(spark, sf), order_events(spark, sf), conform(c, EVENT)])


def declarations(spark, sf) -> DataFrame:
    """Customer is a member of nation: first by creation, again by each order, active unless its status is F."""
    c = customers(spark, sf)
    last = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    cols = lambda at, active, key: [make_id("relationship_declaration", *key).alias("relationship_declaration_id"), make_id("event", *key).alias("event_id"), F.col(at).alias("occurred_at"), F.col("c_custkey").cast("string").alias("entity_a_identifier"), F.lit("customer_key").alias("entity_a_identifier_type"), F.lit("person").alias("entity_a_type"), F.lit("member").alias("entity_a_role"), F.col("c_nationkey").cast("string").alias("entity_b_identifier"), F.lit("nation_key").alias("entity_b_identifier_type"), F.lit("group").alias("entity_b_type"), F.lit("organization").alias("entity_b_role"), F.lit("membership").alias("relationship_type"), F.lit("a_to_b").alias("relationship_direction"), active.alias("is_active"), F.lit("crm").alias("source")]
    return c.select(*cols("at", F.lit(True), [F.lit("customer"), F.col("c_custkey")])).unionByName(last.select(*cols("o_orderdate", F.col("o_orderstatus") != "F", [F.lit("order"), F.col("o_orderkey")])))


def dimensions(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("eid", make_id("event", F.lit("order"), "o_orderkey"))
    one = lambda n, v: o.select(make_id("event_dimension", "eid", F.lit(n)).alias("event_dimension_id"), F.col("eid").alias("event_id"), F.lit(n).alias("dimension_name"), v.alias("dimension_value"), F.col("o_orderdate").alias("occurred_at"), F.lit("Orders").alias("source"), F.col("o_orderdate").alias("_ingested_at"))
    return one("Priority", F.col("o_orderpriority")).unionByName(one("is_urgent", F.col("o_orderpriority").like("1-%").cast("string")))


def measurements(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("eid", make_id("event", F.lit("order"), "o_orderkey"))
    q = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    one = lambda d, n, v, u: d.select(make_id("event_measurement", "eid", F.lit(n)).alias("event_measurement_id"), F.col("eid").alias("event_id"), F.lit(n).alias("measurement_name"), v.alias("value"), F.lit(u).alias("value_unit"), F.col("o_orderdate").alias("occurred_at"), F.lit("Orders").alias("source"), F.col("o_orderdate").alias("_ingested_at"))
    return one(o, "Revenue", F.col("o_totalprice"), "USD").unionByName(one(q, "Quantity", F.col("q"), "Count"))


def user_participants(spark, sf) -> DataFrame:
    return _raw_events(spark, sf).select(F.col("eid").alias("event_id"), F.concat(F.lit("user-"), "user_id").alias("entity_id"), F.lit("person").alias("entity_type"), F.lit("visitor").alias("role"), F.col("ts").alias("occurred_at"))


def user_states(spark, sf) -> DataFrame:
    """web_activity: the type of a user's last event; web_value: its value."""
    from pyspark.sql import Window

    e = _raw_events(spark, sf)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    base = e.select(F.concat(F.lit("user-"), "user_id").alias("entity_id"), F.lit("person").alias("entity_type"), "event_type", F.round("value", 2).alias("value"), F.col("ts").alias("state_entered_at"), F.lead("ts").over(w).alias("state_exited_at"), F.col("eid").alias("trigger_event_id"))
    a = base.select("entity_id", "entity_type", F.lit("web_activity").alias("state_name"), F.col("event_type").alias("state_value"), F.lit(None).cast("double").alias("state_numeric_value"), F.lit(None).cast("string").alias("state_category"), "state_entered_at", "state_exited_at", F.col("state_exited_at").isNull().alias("is_current"), "trigger_event_id")
    b = base.select("entity_id", "entity_type", F.lit("web_value").alias("state_name"), F.lit(None).cast("string").alias("state_value"), F.col("value").alias("state_numeric_value"), F.lit("measurement").alias("state_category"), "state_entered_at", "state_exited_at", F.col("state_exited_at").isNull().alias("is_current"), "trigger_event_id")
    return a.unionByName(b)


def touchpoints(spark, sf) -> DataFrame:
    e = _raw_events(spark, sf).where("event_type = 'click'")
    k = F.col("k")
    click = lambda n, p: F.when(k % 10 == n, F.concat(F.lit(p), k.cast("string")))
    e = e.select(
        make_id("touchpoint", "eid", "ts").alias("touchpoint_id"), F.col("eid").alias("touchpoint_event_id"), F.col("ts").alias("occurred_at"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("source"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("medium"),
        F.concat(F.lit("c"), (k % 7).cast("string")).alias("campaign"), F.when(k % 2 == 0, "paid").otherwise("social").alias("channel"), click(0, "g").alias("gclid"), click(1, "f").alias("fbclid"), click(2, "t").alias("ttclid"), click(3, "l").alias("li_fat_id"),
        F.when(k % 10 == 4, F.concat(F.lit("https://shop.test/?rdt_cid=r"), k.cast("string"))).when(k % 10 == 5, F.concat(F.lit("https://shop.test/?rdclid=q"), k.cast("string"))).otherwise("https://shop.test/").alias("landing_url"),
    )
    e = e.withColumn("touchpoint_type", F.when(F.col("source") == "s3", "store").otherwise("web"))
    return e.withColumn("attribution_deduplication_key", make_id("attribution_deduplication_key", "source", "medium", "campaign"))

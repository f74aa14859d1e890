"""Web analytics calls: events, identifiers and touchpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.functions.normalize import CLICK_IDS, channel, click_id, norm_email, norm_phone
from idloom.operators.relational import latest

# Fixed value: a call without a real time carries one at or before this.
FIRST_TIME = "1900-01-01 00:00:00"


def cleaned(df: DataFrame) -> DataFrame:
    """Columns named like addresses and phones, normalised."""
    fix = lambda c: norm_email(F.col(c)) if "email" in c.lower() else norm_phone(F.col(c)) if "phone" in c.lower() else F.col(c)
    return df.select(*[fix(c).alias(c) for c in df.columns])


def events(calls: DataFrame, prefix: str = "") -> DataFrame:
    """Event rows of calls with a real time; received_at is the ingestion time. The latest copy of each call counts."""
    c = latest(calls.where(F.col("occurred_at") > F.lit(FIRST_TIME).cast("timestamp_ntz")).select("event_id", "received_at", "occurred_at", "event_name", "event_text", "event_type", "segment_source", "_ingested_at"), ["event_id"], ["received_at", "occurred_at", "_ingested_at"])
    return c.select("event_id", "occurred_at", F.concat(F.lit(prefix), "event_name").alias("event_name"), F.coalesce("event_text", "event_name").alias("event_description"), "event_type", F.lit(0.0).alias("significance"), F.lit("segment").alias("source"), F.col("segment_source").alias("source_table"), F.coalesce("received_at", "_ingested_at").alias("_ingested_at"))


def touchpoints(calls: DataFrame, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """Attributed touchpoints, and the first web call of each device where it is not attributed.

    A call is attributed by a campaign field, a click id or a referrer that ``exclusions`` (LIKE patterns) don't leave out;
    blank ones count, as they do in the model this follows. The first web call is taken over all calls of the device; it
    gives a direct touchpoint only if all these are missing or blank, so a device that came by a campaign has none. Direct
    ones are told apart by their landing page. Campaign content and term are null where the calls lack them.
    """
    c = calls.where(F.col("occurred_at") > F.lit(FIRST_TIME).cast("timestamp_ntz"))
    extra = [n for n in ("context_campaign_content", "context_campaign_term") if n in calls.columns]
    c = latest(c.select("event_id", "received_at", "occurred_at", "anonymous_id", "event_name", "event_type", "page_url", "page_referrer", "context_page_path", "context_campaign_source", "context_campaign_medium", "context_campaign_name", *extra), ["event_id"], ["received_at", "occurred_at"])
    c = c.withColumns({n: F.lit(None).cast("string") for n in ("context_campaign_content", "context_campaign_term") if n not in extra})
    ref, url = F.col("page_referrer"), F.col("page_url")
    counted, ignored = ref.isNotNull(), ref.isNull() | (ref == "")
    for p in exclusions:
        counted, ignored = counted & ~ref.like(p), ignored | ref.like(p)
    base = c.select("*", channel(F.col("context_campaign_source"), ref, url, exclusions).alias("channel"), *[click_id(url, n).alias(n) for n in CLICK_IDS])
    campaign = ("context_campaign_source", "context_campaign_medium", "context_campaign_name")
    marked = F.coalesce(F.coalesce(*campaign, *CLICK_IDS).isNotNull() | counted, F.lit(False))
    cols = dict(source="context_campaign_source", medium="context_campaign_medium", campaign="context_campaign_name", content="context_campaign_content", term="context_campaign_term")
    page = [F.col("context_page_path").alias("landing_page"), F.col("page_referrer").alias("referrer"), F.col("page_url").alias("landing_url")]
    head = [make_id("touchpoint", "event_id", "occurred_at").alias("touchpoint_id"), F.col("event_id").alias("touchpoint_event_id"), "event_name", "event_type", "occurred_at"]
    found = base.where(marked).select(*head, *[F.col(v).alias(k) for k, v in cols.items()], "channel", *page, *CLICK_IDS)
    found = found.withColumn("attribution_deduplication_key", make_id("attribution_deduplication_key", *cols, "referrer", *CLICK_IDS))
    visits = base.where((F.col("event_type") == "web") & F.col("anonymous_id").isNotNull())
    first = visits.groupBy("anonymous_id").agg(F.min("occurred_at").alias("_first"))
    blank = F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in campaign], *CLICK_IDS).isNull() & ignored
    # Calls without a type join too, as only the device and the time are compared.
    direct = base.join(first, "anonymous_id").where((F.col("occurred_at") == F.col("_first")) & blank)
    none = lambda n: F.lit(None).cast("string").alias(n)
    direct = direct.select(*head, *map(none, cols), F.lit("direct").alias("channel"), page[0], none("referrer"), page[2], *map(none, CLICK_IDS), make_id("attribution_deduplication_key", F.lit("direct"), "context_page_path").alias("attribution_deduplication_key"))
    return found.unionByName(direct).withColumn("touchpoint_type", F.lit("web"))

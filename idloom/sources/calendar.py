"""Calendar: raw envelopes to typed events, participants and the rows they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.functions.normalize import domain_filter, norm_email, redirected_domain, unquoted
from idloom.functions.payload import get_text, payload
from idloom.functions.times import iso_utc
from idloom.operators.relational import latest


def deduped(raw: DataFrame) -> DataFrame:
    """The latest row of each event key: iCalUID, with the instance's start where it recurs."""
    p = raw.withColumn("_p", payload(F.col("_raw_record")))
    f = lambda n: get_text(F.col("_p"), f"$.{n}")
    recurs = f("recurringEventId").isNotNull() | F.try_variant_get("_p", "$.recurrence", "array<variant>").isNotNull()
    start = F.coalesce(f("originalStartTime.dateTime"), f("start.dateTime"), f("start.date"))
    key = F.when(recurs, F.concat(f("iCalUID"), F.lit("|"), start)).otherwise(f("iCalUID"))
    d = p.select(key.alias("event_key"), recurs.alias("is_recurring"), "_ingested_at", "_account", "_raw_record").where("event_key is not null")
    return latest(d, ["event_key"], ["_ingested_at", "_raw_record"])


def normalized(events: DataFrame, internal_domains: tuple[str, ...] = ()) -> DataFrame:
    """Typed events. An attendee or organizer with an address outside the internal domains is external. All-day ones run from the first to the last second of their dates; without internal domains everyone with an address is external."""
    p = events.withColumn("_p", payload(F.col("_raw_record")))
    f = lambda n: get_text(F.col("_p"), f"$.{n}")
    people = F.coalesce(F.try_variant_get("_p", "$.attendees", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    domain = lambda a: F.split_part(F.lower(F.try_variant_get(a, "$.email", "string")), F.lit("@"), F.lit(2))
    host = F.try_variant_get("_p", "$.organizer", "variant")
    is_outside = lambda a: domain(a).isNotNull() & (~domain(a).isin(*internal_domains) if internal_domains else F.lit(True))
    outside = F.coalesce(F.exists(people, is_outside), F.lit(False)) | F.coalesce(is_outside(host), F.lit(False))
    all_day = f("start.dateTime").isNull() & f("start.date").isNotNull()
    start = F.coalesce(iso_utc(f("start.dateTime")), iso_utc(F.concat(f("start.date"), F.lit("T00:00:00Z"))))
    end = F.coalesce(iso_utc(f("end.dateTime")), iso_utc(F.concat(f("end.date"), F.lit("T23:59:59Z"))))
    return p.select("event_key", f("summary").alias("summary"), f("status").alias("status"), f("location").alias("location"), start.alias("starts_at"), end.alias("ends_at"), all_day.alias("is_all_day"), "is_recurring", F.coalesce(outside, F.lit(False)).alias("has_external_attendees"), F.size(people).cast("bigint").alias("attendee_count"), "_account", "_ingested_at")


def participants(events: DataFrame) -> DataFrame:
    """Organizer, creator and attendees with a valid address, once per (event, address, role)."""
    p = events.withColumn("_p", payload(F.col("_raw_record")))
    one = lambda n: p.select("event_key", F.lit(n).alias("role"), F.try_variant_get("_p", f"$.{n}", "variant").alias("_a"))
    a = p.select("event_key", F.lit("attendee").alias("role"), F.explode(F.try_variant_get("_p", "$.attendees", "array<variant>")).alias("_a"))
    u = one("organizer").unionByName(one("creator")).unionByName(a)
    name = unquoted(F.regexp_replace(F.try_variant_get("_a", "$.displayName", "string"), r"\s*\([^()]*@[^()]*\)$", ""))
    u = u.select("event_key", "role", norm_email(F.try_variant_get("_a", "$.email", "string")).alias("email"), name.alias("name"), F.try_variant_get("_a", "$.responseStatus", "string").alias("response")).where("email is not null")
    g = u.groupBy("event_key", "email", "role").agg(F.max("name").alias("name"), F.max("response").alias("response"))
    return g.withColumn("domain", F.split_part("email", F.lit("@"), F.lit(2)))


def meeting_events(norm: DataFrame) -> DataFrame:
    n = norm.where(F.coalesce("status", F.lit("")) != "cancelled")
    return n.select(make_id("event", F.lit("calendar"), "event_key").alias("event_id"), F.col("starts_at").alias("occurred_at"), F.when(F.col("has_external_attendees"), "external_meeting").otherwise("internal_meeting").alias("event_name"), F.col("summary").alias("event_description"), F.lit("meeting").alias("event_type"), F.lit(100.0).alias("significance"), F.lit("calendar").alias("source"))


def person_identifiers(parts: DataFrame, norm: DataFrame) -> DataFrame:
    ev = make_id("event", F.lit("calendar"), "event_key")
    j = parts.join(norm.select("event_key", "starts_at"), "event_key")
    return j.select(make_id("entity_identifier", ev, "email", "role").alias("entity_identifier_id"), ev.alias("event_id"), make_id("edge", ev, "email").alias("edge_id"), F.lit("person").alias("entity_type"), F.lit("email").alias("identifier_type"), F.col("email").alias("identifier_value"), "role", F.lit("calendar").alias("source"), F.col("starts_at").alias("occurred_at"))


def _timed(parts: DataFrame, norm: DataFrame) -> DataFrame:
    return parts.join(norm.select("event_key", "starts_at"), "event_key").withColumn("event_id", make_id("event", F.lit("calendar"), "event_key"))


def _domains(parts: DataFrame, norm: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    return _timed(parts, norm).where(domain_filter(F.col("domain"), exclude=list(exclude)) & ~F.col("domain").contains(">"))


def group_identifiers(parts: DataFrame, norm: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Domain rows of each meeting and role, each with its www twin."""
    d = _domains(parts, norm, exclude).select("event_id", "starts_at", "role", F.explode(F.array("domain", redirected_domain(F.col("domain")))).alias("value")).distinct()
    return d.select(make_id("entity_identifier", "event_id", "value", F.lit("group"), "role", "starts_at").alias("entity_identifier_id"), "event_id", make_id("edge", "event_id", "value", F.lit("group"), "role").alias("edge_id"), F.lit("group").alias("entity_type"), F.lit("domain").alias("identifier_type"), F.col("value").alias("identifier_value"), "role", F.lit("calendar").alias("source"), F.col("starts_at").alias("occurred_at"))


def _traits(rows: DataFrame, entity_type: str, identifier_type: str, value: str, trait: str, trait_value: str, *more: str) -> DataFrame:
    return rows.where(F.col(trait_value).isNotNull()).select(
        make_id("entity_trait", "event_id", value, F.lit(entity_type), F.lit(trait), *more).alias("entity_trait_id"), "event_id", F.lit(entity_type).alias("entity_type"), F.lit(identifier_type).alias("identifier_type"), F.col(value).alias("identifier_value"),
        F.lit(trait).alias("trait_name"), F.col(trait_value).alias("trait_value"), F.lit("calendar").alias("source"), F.col("starts_at").alias("occurred_at"),
    ).distinct()


def person_traits(parts: DataFrame, norm: DataFrame) -> DataFrame:
    """Name and address of each participant and role."""
    t = _timed(parts, norm)
    return _traits(t, "person", "email", "email", "name", "name", "role").unionByName(_traits(t, "person", "email", "email", "email", "email", "role"))


def group_traits(parts: DataFrame, norm: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Each meeting's domains as a trait of theirs."""
    return _traits(_domains(parts, norm, exclude), "group", "domain", "domain", "domain", "domain")


def declarations(parts: DataFrame, norm: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Each participant is a member of the organization of the address's domain."""
    d = _domains(parts, norm, exclude).where("email is not null").select("event_id", "starts_at", "email", "domain").distinct()
    return d.select(
        make_id("relationship_declaration", "event_id", "email", "domain", F.lit("member"), "starts_at").alias("relationship_declaration_id"), "event_id", F.col("starts_at").alias("occurred_at"), F.col("email").alias("entity_a_identifier"), F.lit("email").alias("entity_a_identifier_type"), F.lit("person").alias("entity_a_type"), F.lit("member").alias("entity_a_role"),
        F.col("domain").alias("entity_b_identifier"), F.lit("domain").alias("entity_b_identifier_type"), F.lit("group").alias("entity_b_type"), F.lit("organization").alias("entity_b_role"), F.lit("membership").alias("relationship_type"), F.lit("a_to_b").alias("relationship_direction"), F.lit(True).alias("is_active"), F.lit("calendar").alias("source"),
    )

"""Mail: raw envelopes to messages, threads, participants, and the event-log rows they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.functions.jsonx import header
from idloom.functions.normalize import clean_subject, domain_filter, empty_to_null, html_decode, mail_address, mail_name, norm_email, redirected_domain, unquoted
from idloom.functions.payload import get_text, payload
from idloom.functions.times import from_millis
from idloom.operators.relational import latest, union_aligned

# Headers that mark bulk or automatic mail whenever they are not blank.
BULK_MARKS = ("list-id", "list-unsubscribe", "x-auto-response-suppress", "x-autoreply", "x-autorespond")
# Fixed value: roles in the order they are listed in.
ROLES = ("sender", "recipient", "cced", "bcced")


def deduped(raw: DataFrame) -> DataFrame:
    """The latest row of each message id (not per account); rows without a readable id are dropped."""
    r = raw.withColumn("_p", payload(F.col("_raw_record"))).withColumn("message_id", empty_to_null(get_text(F.col("_p"), "$.id")))
    keep = ["_raw_record", "_connection_id", "_stream_id", "_account", "_sync_id"]
    return latest(r.where("message_id is not null").select("message_id", "_ingested_at", "_row_id", *keep), ["message_id"], ["_ingested_at", "_row_id"])


def _headers() -> Column:
    return F.try_variant_get("_p", "$.headers", "array<variant>")


def parsed(messages: DataFrame) -> DataFrame:
    m = messages.withColumn("_p", payload(F.col("_raw_record"))).withColumn("_h", _headers())
    return m.select("message_id", "_account", "_stream_id", "_ingested_at", "_p", "_h", from_millis(get_text(F.col("_p"), "$.internalDate").try_cast("bigint")).alias("sent_at"))


def by_account(messages: DataFrame) -> DataFrame:
    """One row per message: headers, cleaned subject, labels, decoded snippet and the bulk flag (seven headers tell)."""
    m = parsed(messages)
    bulk = reduce(lambda a, b: a | b, [F.coalesce(F.trim(header(F.col("_h"), n)), F.lit("")) != "" for n in BULK_MARKS])
    bulk = bulk | F.coalesce(F.lower(header(F.col("_h"), "precedence")), F.lit("")).isin("bulk", "list", "junk") | F.lower(F.coalesce(header(F.col("_h"), "auto-submitted"), F.lit(""))).startswith("auto-")
    return m.select(
        "message_id", "_account", "_stream_id", get_text(F.col("_p"), "$.threadId").alias("thread_id"), header(F.col("_h"), "message-id").alias("message_id_header"), header(F.col("_h"), "from").alias("from_header"),
        header(F.col("_h"), "subject").alias("raw_subject"), clean_subject(header(F.col("_h"), "subject")).alias("subject"), html_decode(get_text(F.col("_p"), "$.snippet")).alias("snippet"),
        F.try_variant_get("_p", "$.labelIds", "array<string>").alias("label_ids"), "sent_at", bulk.alias("is_bulk"), "_ingested_at",
    )


def participants(messages: DataFrame) -> DataFrame:
    """One row per (message, account, address, role): From, To, Cc and Bcc split at every comma; rows without a valid
    address are dropped. Copies keep the row with the greatest raw text."""
    m = parsed(messages)
    one = lambda h, role, many: m.select("message_id", "_account", "sent_at", "_ingested_at", F.lit(role).alias("role"), (F.explode(F.split(header(F.col("_h"), h), ",")) if many else header(F.col("_h"), h)).alias("raw"))
    p = one("from", "sender", False).unionByName(one("to", "recipient", True)).unionByName(one("cc", "cced", True)).unionByName(one("bcc", "bcced", True))
    raw = F.trim("raw")
    p = p.where(raw != "").select("message_id", "_account", "role", "sent_at", "_ingested_at", raw.alias("raw"), norm_email(mail_address(raw)).alias("email"), unquoted(mail_name(raw)).alias("name"))
    p = latest(p.where("email is not null"), ["message_id", "_account", "email", "role"], ["_ingested_at", "sent_at", "raw"])
    return p.select("message_id", "_account", "email", F.split_part("email", F.lit("@"), F.lit(2)).alias("domain"), "name", "role", "sent_at", "_ingested_at")


def threads(msgs: DataFrame) -> DataFrame:
    """One row per (thread, account, stream): counts, first and last time, earliest subject, union of labels."""
    g = msgs.where("thread_id is not null").groupBy("thread_id", "_account", "_stream_id").agg(
        F.count("*").alias("message_count"), F.min("sent_at").alias("first_sent_at"), F.max("sent_at").alias("last_sent_at"), F.min(F.struct(F.col("sent_at").isNull(), "sent_at", "message_id", "subject", "raw_subject", "message_id_header")).alias("m"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("label_ids")))).alias("label_ids"), F.max("_ingested_at").alias("_watermark_ingested_at"), F.min("_ingested_at").alias("_ingested_at"),
    )
    return g.select("thread_id", "_account", "_stream_id", "message_count", "first_sent_at", "last_sent_at", F.col("m.subject").alias("subject"), F.col("m.raw_subject").alias("raw_subject"), F.col("m.message_id").alias("first_message_id"), F.col("m.message_id_header").alias("first_message_id_header"), "label_ids", "_ingested_at", "_watermark_ingested_at")


def thread_participants(msgs: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per (thread, account, email, domain) with its roles in their order."""
    j = parts.join(msgs.select("message_id", "_account", "thread_id"), ["message_id", "_account"]).where("thread_id is not null")
    first_name = F.min(F.when(F.col("name").isNotNull(), F.struct("sent_at", "name")))["name"].alias("name")
    g = j.groupBy("thread_id", "_account", "email", "domain").agg(F.collect_set("role").alias("_r"), first_name, F.max("_ingested_at").alias("_watermark_ingested_at"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"), F.count_distinct("message_id").alias("message_count"))
    return g.withColumn("roles", F.filter(F.array(*map(F.lit, ROLES)), lambda r: F.array_contains("_r", r))).drop("_r")


def _json_text(c: Column) -> Column:
    """A text as it stands in JSON."""
    return F.regexp_replace(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"^\[|\]$", "")


def _object_of(pairs: Column, value) -> Column:
    """``{"key": value, ...}`` of an array of (k, v) structs."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: F.concat(_json_text(x["k"]), F.lit(": "), value(x["v"]))), ", "), F.lit("}"))


def participant_summary(parts: DataFrame, internal_domains: tuple[str, ...] = ()) -> DataFrame:
    """(message_id, _account, participant_count, internal and external counts, domains). Without internal domains everyone
    is external."""
    inside = F.col("domain").isin(*[d.lower() for d in internal_domains]) if internal_domains else F.lit(False)
    return parts.groupBy("message_id", "_account").agg(
        F.count("*").alias("participant_count"), F.count_if(inside).alias("internal_participant_count"), F.count_if(~inside).alias("external_participant_count"), F.array_sort(F.collect_set(F.lower("domain"))).alias("participant_domains"),
    )


def with_participants(msgs: DataFrame, parts: DataFrame, internal_domains: tuple[str, ...] = (), drop_internal_only: bool = False) -> DataFrame:
    """Messages with their participant counts. ``drop_internal_only`` keeps those with an external participant or without
    any that could be read."""
    m = msgs.join(participant_summary(parts, internal_domains), ["message_id", "_account"], "left").fillna(0, ["participant_count", "internal_participant_count", "external_participant_count"])
    m = m.withColumns({"participant_domains": F.coalesce("participant_domains", F.expr("cast(array() as array<string>)")), "is_internal_only": (F.col("participant_count") > 0) & (F.col("external_participant_count") == 0)})
    return m.where("not is_internal_only") if drop_internal_only else m


def threads_across(threads: DataFrame) -> DataFrame:
    """One row per thread over all accounts, told by its first Message-ID: earliest subject, times, thread ids and labels by
    stream as JSON, all labels."""
    g = threads.where("first_message_id_header is not null").groupBy(F.col("first_message_id_header").alias("thread_id")).agg(
        F.min(F.struct(F.col("first_sent_at").isNull(), "first_sent_at", "_account", "_stream_id", F.col("thread_id").alias("_t"), "subject", "raw_subject")).alias("m"), F.min("first_sent_at").alias("first_sent_at"), F.max("last_sent_at").alias("last_sent_at"),
        F.array_sort(F.collect_list(F.struct(F.col("_stream_id").alias("k"), F.col("thread_id").alias("v")))).alias("_ids"), F.array_sort(F.collect_list(F.struct(F.col("_stream_id").alias("k"), F.col("label_ids").alias("v")))).alias("_labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("label_ids")))).alias("all_label_ids"),
        F.min("_ingested_at").alias("_ingested_at"), F.max("_watermark_ingested_at").alias("_watermark_ingested_at"),
    )
    return g.select("thread_id", F.col("m.subject").alias("subject"), F.col("m.raw_subject").alias("raw_subject"), "first_sent_at", "last_sent_at", _object_of(F.col("_ids"), _json_text).alias("thread_ids_by_stream"), _object_of(F.col("_labels"), F.to_json).alias("labels_by_stream"), "all_label_ids", "_ingested_at", "_watermark_ingested_at")


def thread_participants_across(thread_parts: DataFrame, threads: DataFrame) -> DataFrame:
    """One row per (thread over all accounts, email, domain): its earliest name, its roles in their order, its times."""
    t = threads.where("first_message_id_header is not null").select("thread_id", "_account", F.col("first_message_id_header").alias("_first"), F.col("_watermark_ingested_at").alias("_w"))
    j = thread_parts.join(t, ["thread_id", "_account"])
    g = j.groupBy(F.col("_first").alias("thread_id"), "email", "domain").agg(
        F.min(F.when(F.col("name").isNotNull(), F.struct("first_at", "name")))["name"].alias("name"), F.array_distinct(F.flatten(F.collect_set("roles"))).alias("_r"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max(F.greatest("_watermark_ingested_at", "_w")).alias("_watermark_ingested_at"),
    )
    return g.withColumn("roles", F.filter(F.array(*map(F.lit, ROLES)), lambda r: F.array_contains("_r", r))).drop("_r")


def touched_threads(threads: DataFrame, thread_parts: DataFrame, mark) -> DataFrame:
    """(first_message_id_header): the threads to build anew after ``mark``, where either they or one of their participants
    has changed."""
    t = threads.where("first_message_id_header is not null")
    own = t.where(F.col("_watermark_ingested_at") > F.lit(mark)).select("first_message_id_header")
    late = thread_parts.where(F.col("_watermark_ingested_at") > F.lit(mark)).select("thread_id", "_account").distinct()
    return own.unionByName(t.join(late, ["thread_id", "_account"], "left_semi").select("first_message_id_header")).distinct()


def across_accounts(msgs: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """One row per Message-ID header over all accounts: the latest copy, bulk if any copy is, ids by account as JSON. With
    ``threads`` (by account) thread_id is the first Message-ID of the copy's thread."""
    if threads is not None:
        first = threads.select("thread_id", "_account", F.col("_stream_id").alias("_s"), F.col("first_message_id_header").alias("_first"))
        msgs = msgs.join(first.select(*[F.col(c).alias("_x" + c) for c in first.columns]), (msgs["thread_id"] == F.col("_xthread_id")) & msgs["_account"].eqNullSafe(F.col("_x_account")) & msgs["_stream_id"].eqNullSafe(F.col("_x_s")), "left").withColumn("thread_id", F.col("_x_first")).select(*msgs.columns)
    g = msgs.where("message_id_header is not null").groupBy("message_id_header").agg(
        F.max(F.struct("sent_at", "message_id", "subject", "thread_id", "_account")).alias("m"), F.bool_or("is_bulk").alias("is_bulk"), F.count_distinct("_account").alias("account_count"),
        F.array_sort(F.collect_set(F.struct(F.col("_account").alias("k"), F.col("message_id").alias("v")))).alias("_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("label_ids")))).alias("all_label_ids"),
    )
    text = _object_of(F.col("_ids"), _json_text)
    return g.select("message_id_header", F.col("m.message_id").alias("latest_message_id"), F.col("m.subject").alias("subject"), F.col("m.thread_id").alias("thread_id"), F.col("m.sent_at").alias("sent_at"), "is_bulk", "account_count", text.alias("ids_by_account"), "all_label_ids")


def participants_across(msgs: DataFrame, parts: DataFrame) -> DataFrame:
    """The latest row of each (Message-ID header, email, role)."""
    j = parts.join(msgs.select("message_id", "_account", "message_id_header"), ["message_id", "_account"]).where("message_id_header is not null")
    return latest(j.select("message_id_header", "email", "domain", "role", "name", "sent_at", "message_id"), ["message_id_header", "email", "role"], ["sent_at", "message_id"])


def bodies(raw: DataFrame) -> DataFrame:
    """The body fields of each Message-ID header, the latest fetched."""
    p = raw.withColumn("_p", payload(F.col("_raw_record")))
    f = lambda n: get_text(F.col("_p"), f"$.{n}")
    b = p.select(f("message_id_header").alias("message_id_header"), F.to_timestamp(f("fetched_at")).cast("timestamp_ntz").alias("fetched_at"), "_row_id", f("gmail_account_email").alias("account_email"), f("body_size_bytes").try_cast("bigint").alias("body_size_bytes"), f("body_truncated_at_bytes").try_cast("bigint").alias("body_truncated_at_bytes"), F.coalesce(f("body_plain"), f("body_text_from_html")).alias("body_text"))
    return latest(b.where("message_id_header is not null"), ["message_id_header"], ["fetched_at", "_row_id"])


def message_events(across: DataFrame) -> DataFrame:
    """Event rows: bulk mail weighs -10, other mail 10."""
    return across.select(make_id("event", F.lit("mail"), "message_id_header").alias("event_id"), F.col("sent_at").alias("occurred_at"), F.lit("email message").alias("event_name"), F.col("subject").alias("event_description"), F.lit("email").alias("event_type"), F.when(F.col("is_bulk"), -10.0).otherwise(10.0).alias("significance"), F.lit("mail").alias("source"))


def person_identifiers(parts: DataFrame) -> DataFrame:
    """An identifier row per participant. Its edge hashes the identifier itself: people in one mail are not merged."""
    ev = make_id("event", F.lit("mail"), "message_id_header")
    return parts.select(make_id("entity_identifier", ev, "email", "role").alias("entity_identifier_id"), ev.alias("event_id"), make_id("edge", ev, "email").alias("edge_id"), F.lit("person").alias("entity_type"), F.lit("email").alias("identifier_type"), F.col("email").alias("identifier_value"), "role", F.lit("mail").alias("source"), F.col("sent_at").alias("occurred_at")).distinct()


def group_identifiers(parts: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Domain rows of each message, each with its www twin."""
    d = parts.where(domain_filter(F.col("domain"), exclude=list(exclude))).select("message_id_header", "sent_at", F.explode(F.array("domain", redirected_domain(F.col("domain")))).alias("value")).distinct()
    ev = make_id("event", F.lit("mail"), "message_id_header")
    return d.select(make_id("entity_identifier", ev, "value").alias("entity_identifier_id"), ev.alias("event_id"), make_id("edge", ev, "value").alias("edge_id"), F.lit("group").alias("entity_type"), F.lit("domain").alias("identifier_type"), F.col("value").alias("identifier_value"), F.lit("organization").alias("role"), F.lit("mail").alias("source"), F.col("sent_at").alias("occurred_at"))


def person_traits(parts: DataFrame) -> DataFrame:
    """Name and address of each participant."""
    ev = make_id("event", F.lit("mail"), "message_id_header")
    t = parts.select("message_id_header", "sent_at", "email", F.explode(F.array(F.struct(F.lit("name").alias("n"), F.col("name").alias("v")), F.struct(F.lit("email").alias("n"), F.col("email").alias("v")))).alias("t")).where("t.v is not null").distinct()
    return t.select(make_id("entity_trait", ev, "email", F.col("t.n"), F.col("t.v")).alias("entity_trait_id"), ev.alias("event_id"), F.lit("person").alias("entity_type"), F.lit("email").alias("identifier_type"), F.col("email").alias("identifier_value"), F.col("t.n").alias("trait_name"), F.col("t.v").alias("trait_value"), F.col("sent_at").alias("occurred_at"))


def declarations(parts: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Each person is a member of the organization of the mail domain."""
    ev = make_id("event", F.lit("mail"), "message_id_header")
    p = parts.where(domain_filter(F.col("domain"), exclude=list(exclude))).select("message_id_header", "sent_at", "email", "domain").distinct()
    return p.select(make_id("relationship_declaration", ev, "email", "domain").alias("relationship_declaration_id"), ev.alias("event_id"), F.col("sent_at").alias("occurred_at"), F.col("email").alias("entity_a_identifier"), F.lit("member").alias("entity_a_role"), F.col("domain").alias("entity_b_identifier"), F.lit("organization").alias("entity_b_role"), F.lit("membership").alias("relationship_type"), F.lit("a_to_b").alias("relationship_direction"))


def _thread_event() -> Column:
    return make_id("event", "thread_id", F.lit("thread started"))


def thread_events(threads: DataFrame) -> DataFrame:
    """Event rows: the start of each thread over all accounts, without weight."""
    return threads.select(_thread_event().alias("event_id"), F.col("first_sent_at").alias("occurred_at"), F.lit("thread started").alias("event_name"), F.col("subject").alias("event_description"), F.lit("email").alias("event_type"), F.lit(0.0).alias("significance"), F.lit("mail").alias("source"), F.col("_watermark_ingested_at").alias("_ingested_at"))


def _thread_rows(parts: DataFrame, value: str, entity_type: str, identifier_type: str) -> DataFrame:
    p = parts.where(F.col(value).isNotNull()).select(_thread_event().alias("event_id"), F.col(value).alias("identifier_value"), F.col("first_at").alias("occurred_at"), F.col("_watermark_ingested_at").alias("_ingested_at"), F.explode("roles").alias("role"))
    key = ["event_id", "identifier_value", F.lit(entity_type), "role"]
    p = p.select(make_id("entity_identifier", *key).alias("entity_identifier_id"), "event_id", make_id("edge", *key).alias("edge_id"), F.lit(entity_type).alias("entity_type"), F.lit(identifier_type).alias("identifier_type"), "identifier_value", F.lit("mail").alias("source"), "occurred_at", "_ingested_at", "role")
    return latest(p, ["entity_identifier_id"], ["_ingested_at", "occurred_at"])


def thread_person_identifiers(parts: DataFrame) -> DataFrame:
    """An identifier row per participant and role of a thread over all accounts; the latest ingested of each id."""
    return _thread_rows(parts, "email", "person", "email")


def thread_group_identifiers(parts: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The same for the domains, each with its www twin."""
    p = parts.where(domain_filter(F.col("domain"), exclude=list(exclude))).withColumn("_d", F.explode(F.array("domain", redirected_domain(F.col("domain")))))
    return _thread_rows(p, "_d", "group", "domain")


def group_traits(parts: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Each message's domains as a trait of theirs; the latest sent of each id."""
    ev = make_id("event", F.lit("mail"), "message_id_header")
    d = parts.where(domain_filter(F.col("domain"), exclude=list(exclude)) & ~F.col("domain").contains(">")).select(ev.alias("event_id"), "domain", "sent_at").distinct()
    t = d.select(make_id("entity_trait", "event_id", "domain", F.lit("group"), F.lit("domain")).alias("entity_trait_id"), "event_id", F.lit("group").alias("entity_type"), F.lit("domain").alias("identifier_type"), F.col("domain").alias("identifier_value"), F.lit("domain").alias("trait_name"), F.col("domain").alias("trait_value"), F.lit("mail").alias("source"), F.col("sent_at").alias("occurred_at"))
    return latest(t, ["entity_trait_id"], ["occurred_at"])


def layer(parts: list[DataFrame]) -> DataFrame:
    """One relation of events, identifiers or traits of all kinds of mail rows; missing columns are null."""
    return union_aligned(parts)

"""Queries over scalar functions, relational helpers, source templates and the incremental operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.functions import jsonx as jx
from idloom.functions import normalize as nz
from idloom.functions import times as tm
from idloom.functions.payload import payload
from idloom.operators import metadata as md
from idloom.operators import relational as rl
from idloom.plans import fixtures as fx
from idloom.plans.sql import C, full, sid
from idloom.sources import calendar as cal
from idloom.sources import mail, web
from idloom.sources import plans as pl
from idloom.sources import tables as tb
from idloom.streaming import incremental as inc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = full(sql)
        return f

    return add


# Fixed edge cases of the text functions.
CASES = (None, "", "None", "null", " A.B+x@GMAIL.com ", "Foo@Bar.org", "@", "not mail", "0000000000", "1234567890", "+1 555 0101", "Name <a.b@gmail.com>", "www.shop.test", "shop.test", "a &amp;lt; b &quot;c&quot;", "Re: Fwd: RE: hello", "2023-01-15", "12:30:05", "1:2:3:4", "7:8", "x")
_CASES = "(values " + ", ".join("(" + ("null" if c is None else "'" + c.replace("'", "''") + "'") + ")" for c in CASES) + ") v(t)"


def _cases(s) -> DataFrame:
    return s.createDataFrame([(c,) for c in CASES], "t string")


def _case(name: str, col, sql: str) -> None:
    q(name, f"select t, {sql} as r from {_CASES}")(lambda s, d: _cases(s).select("t", col(F.col("t")).alias("r")))


_EMAIL_SQL = "case when regexp_matches(lower(trim(t)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$') then case when split_part(lower(trim(t)), '@', 2) in ('gmail.com', 'googlemail.com') then replace(split_part(lower(trim(t)), '@', 1), '.', '') || '@' || split_part(lower(trim(t)), '@', 2) else lower(trim(t)) end end"
_FAKE = ", ".join(f"'{p}'" for p in nz.FAKE_PHONES)
_case("norm_email", nz.norm_email, _EMAIL_SQL)
_case("norm_phone", nz.norm_phone, f"case when trim(t) <> '' and not contains(trim(t), '@') and trim(t) not in ({_FAKE}) then trim(t) end")
_case("mail_address", nz.mail_address, "case when contains(t, '<') and contains(t, '>') then regexp_extract(t, '<([^>]+)>', 1) else trim(t) end")
_case("mail_name", nz.mail_name, "nullif(trim(regexp_extract(t, '^([^<]+)<', 1)), '')")
_case("redirected_domain", nz.redirected_domain, "case when starts_with(t, 'www.') then substr(t, 5) else 'www.' || t end")
_DECODE = reduce(lambda x, e: f"replace({x}, '{e[0]}', '{e[1].replace(chr(39), chr(39) * 2)}')", nz.ENTITIES, "coalesce(t, '')")
_case("html_decode", nz.html_decode, _DECODE)
_case("null_string_cast", lambda c: nz.null_safe_cast(c, "date"), "case when t not in ('null', 'NULL', 'None', 'none', '') then try_cast(t as date) end")
_case("clean_subject", nz.clean_subject, "trim(regexp_replace(t, '^(([Rr][Ee]|[Ff][Ww][Dd]?):\\s*){1,4}', ''))")
_case("try_dates", lambda c: tm.try_date(c), "try_cast(t as date)")
_case("interval_seconds", tm.interval_seconds, "case when regexp_full_match(trim(t), '[-+]?\\d+:\\d+:\\d+') then cast(split_part(t, ':', 1) as bigint) * 3600 + cast(split_part(t, ':', 2) as bigint) * 60 + cast(split_part(t, ':', 3) as bigint) end")
_case("case_map", lambda c: nz.case_map(c, {"x": "'ex'", "@": "'at'"}, "'other'"), "case t when 'x' then 'ex' when '@' then 'at' else 'other' end")
q("domain_filter", f"select t from {_CASES} where t is not null and t <> '' and t not in ('x', '@')")(lambda s, d: _cases(s).where(nz.domain_filter(F.col("t"), exclude=["x", "@"])))
q("format_fbc", "select event_id, 'fb.1.' || cast(floor(epoch_us(occurred_at) / 1000.0) as bigint) || '.' || id as fbc from segment_events")(lambda s, d: fx.read(s, d, "segment_events").select("event_id", nz.format_fbc(F.col("id"), F.col("occurred_at")).alias("fbc")))
q("norm_email_values", f"select distinct identifier_value as t, {_EMAIL_SQL.replace('trim(t)', 'trim(identifier_value)')} as r from segment_entity_identifiers")(lambda s, d: fx.read(s, d, "segment_entity_identifiers").select(F.col("identifier_value").alias("t"), nz.norm_email(F.col("identifier_value")).alias("r")).distinct())
q("norm_phone_values", f"select distinct t, case when trim(t) <> '' and not contains(trim(t), '@') and trim(t) not in ({_FAKE}) then trim(t) end as r from (select identifier_value as t from segment_entity_identifiers)")(lambda s, d: fx.read(s, d, "segment_entity_identifiers").select(F.col("identifier_value").alias("t"), nz.norm_phone(F.col("identifier_value")).alias("r")).distinct())
q("click_ids", "select touchpoint_id, nullif(regexp_extract(landing_url, '[?&]rdt_cid=([^&#]+)', 1), '') as rdt_cid from touch")(lambda s, d: fx.touchpoints(s, d).select("touchpoint_id", nz.click_id(F.col("landing_url"), "rdt_cid").alias("rdt_cid")))
q("channel_of", "select event_id, received_at, case when context_campaign_source is not null then 'paid' when page_referrer like '%facebook%' or page_url like '%fbclid%' then 'social' when page_referrer like '%google%' then 'organic' when page_referrer is not null then 'referral' else 'direct' end as channel from segment_events")(lambda s, d: fx.read(s, d, "segment_events").select("event_id", "received_at", nz.channel(F.col("context_campaign_source"), F.col("page_referrer"), F.col("page_url")).alias("channel")))
q("tz_convert", "select event_id, (ts at time zone 'UTC') at time zone 'America/New_York' as local_ts from events")(lambda s, d: fx.read(s, d, "events").select("event_id", tm.convert_timezone(F.col("ts"), "America/New_York").alias("local_ts")))
q("try_timestamps", "select o_orderkey, o_orderdate as parsed from orders")(lambda s, d: fx.read(s, d, "orders").select("o_orderkey", tm.try_timestamp(F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"), "YYYY/MM/DD HH24:MI:SS").alias("parsed")))
q("epoch_conversions", "select event_id, make_timestamp(epoch_us(ts)) as us, make_timestamp((epoch_us(ts) // 1000) * 1000) as ms, make_timestamp((epoch_us(ts) // 1000000) * 1000000) as s from events")(lambda s, d: fx.read(s, d, "events").withColumn("u", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", tm.from_micros(F.col("u")).alias("us"), tm.from_millis(F.expr("u div 1000")).alias("ms"), tm.from_seconds(F.expr("u div 1000000")).alias("s")))
q("json_paths", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as missing from events")(lambda s, d: fx.read(s, d, "events").withColumn("v", F.try_parse_json("props")).select("event_id", jx.json_path(F.col("v"), "k", "int").alias("k"), jx.json_path(F.col("v"), "none", "string").alias("missing")))

# Relational helpers
q("dedupe_latest", "select * exclude (rn) from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")(lambda s, d: rl.latest(fx.read(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]))
q("first_last_flags", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1 as is_first_order, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as is_last_order from orders")(lambda s, d: rl.first_last_flags(fx.read(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "order", "both").select("o_orderkey", "is_first_order", "is_last_order"))
q("join_rename", "select s.*, n.n_name, n.n_regionkey, n.n_nationkey from supplier s left join nation n on n_nationkey = s_nationkey")(lambda s, d: rl.join_resolving(fx.read(s, d, "supplier"), fx.read(s, d, "nation"), "s_nationkey", "n_nationkey"))
q("limit_by_ts", "select * from orders where o_orderdate >= timestamp '1996-01-01'")(lambda s, d: fx.read(s, d, "orders").where(rl.limit_by_timestamp("o_orderdate", "prod_main", prod_limit="1996-01-01")))
q("filter_grammar", "select * from orders where o_orderstatus in ('F', 'O') and o_totalprice > 1000 and o_orderpriority like '1-%' order by o_orderkey limit 50 offset 10")(lambda s, d: rl.select_where(fx.read(s, d, "orders"), [{"column": "o_orderstatus", "operator": "IN", "value": ["F", "O"]}, {"column": "o_totalprice", "operator": ">", "value": 1000}, {"column": "o_orderpriority", "operator": "LIKE", "value": "1-%"}], [F.col("o_orderkey")], 50, 10))
q("union_aligned", "select 'nation' as relation, n_name as name, n_regionkey as region from nation union all select 'region', r_name, null from region")(lambda s, d: rl.union_aligned({"nation": fx.read(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "region": fx.read(s, d, "region").select(F.col("r_name").alias("name"))}, "relation"))
_UNP = " union all ".join(f"select event_id, segment_source as source, occurred_at, _ingested_at, '{t}' as identifier_type, {c} as identifier_value from segment_events where {c} is not null and {c} not in ('null', 'NULL', 'None', 'none', '')" for c, t in (("anonymous_id", "anonymous_id"), ("user_id", "customer")))
q("unpivot_identifiers", f"select {sid('ent_idfr', 'event_id', 'identifier_value', 'null', 'occurred_at', 'identifier_type')} as entity_identifier_id, event_id, {sid('ent_edg', 'event_id', repr('person'))} as edge_id, 'person' as entity_type, identifier_type, identifier_value, cast(null as varchar) as role, source, occurred_at, _ingested_at from ({_UNP})")(
    lambda s, d: rl.unpivot_identifiers(fx.read(s, d, "segment_events"), ["anonymous_id", "user_id"], edge_id="event_id", source="segment_source", types={"user_id": "customer"})
)
_UNT = " union all ".join(f"select *, '{c}' as raw, {c} as v from segment_events where {c} is not null and {c} not in ('null', 'NULL', 'None', 'none', '') and anonymous_id is not null" for c in ("page_title", "context_campaign_name"))
q("unpivot_traits", f"select {sid('ent_tr', 'event_id', 'anonymous_id', repr('person'), 'raw', repr('anonymous_id'))} as entity_trait_id, event_id, 'person' as entity_type, 'anonymous_id' as identifier_type, anonymous_id as identifier_value, raw as trait_name, v as trait_value, segment_source as source, occurred_at from ({_UNT})")(
    lambda s, d: rl.unpivot_traits(fx.read(s, d, "segment_events"), ["page_title", "context_campaign_name"], "anonymous_id", "anonymous_id", source="segment_source")
)

# Web
C["calls"] = "select * exclude (rn) from (select *, row_number() over (partition by event_id order by received_at desc nulls last, occurred_at desc, _ingested_at desc nulls last) as rn from segment_events where occurred_at > timestamp '1900-01-01') where rn = 1"
q("web_events", "select event_id, occurred_at, event_name, coalesce(event_text, event_name) as event_description, event_type, cast(0 as double) as significance, 'segment' as source, segment_source as source_table, coalesce(received_at, _ingested_at) as _ingested_at from calls")(lambda s, d: web.events(fx.read(s, d, "segment_events")))
_CLICKS = ", ".join(f"nullif(regexp_extract(page_url, '[?&]{n}=([^&#]+)', 1), '') as {n}" for n in nz.CLICK_IDS)
_CHANNEL = "case when context_campaign_source is not null then 'paid' when page_referrer like '%facebook%' or page_url like '%fbclid%' then 'social' when page_referrer like '%google%' then 'organic' when page_referrer is not null then 'referral' else 'direct' end"
_TOUCH = "as touchpoint_id, event_id as touchpoint_event_id, event_name, event_type, occurred_at"
_NULLS = lambda *n: ", ".join(f"cast(null as varchar) as {x}" for x in n)
C["tcalls"] = f"select *, {_CHANNEL} as channel, {_CLICKS} from calls"
C["tattr"] = f"select {sid('tch', 'event_id', 'occurred_at')} {_TOUCH}, context_campaign_source as source, context_campaign_medium as medium, context_campaign_name as campaign, cast(null as varchar) as content, cast(null as varchar) as term, channel, context_page_path as landing_page, page_referrer as referrer, page_url as landing_url, {', '.join(nz.CLICK_IDS)} from tcalls where context_campaign_source is not null or context_campaign_medium is not null or context_campaign_name is not null or coalesce({', '.join(nz.CLICK_IDS)}) is not null or page_referrer is not null"
C["tfirst"] = "select anonymous_id, min(occurred_at) as first_at from tcalls where event_type = 'web' and anonymous_id is not null group by 1"
C["tdirect"] = f"select {sid('tch', 'event_id', 'occurred_at')} {_TOUCH}, {_NULLS('source', 'medium', 'campaign', 'content', 'term')}, 'direct' as channel, context_page_path as landing_page, {_NULLS('referrer')}, page_url as landing_url, {_NULLS(*nz.CLICK_IDS)} from tcalls join tfirst using (anonymous_id) where occurred_at = first_at and coalesce(context_campaign_source, '') = '' and coalesce(context_campaign_medium, '') = '' and coalesce(context_campaign_name, '') = '' and coalesce({', '.join('tcalls.' + n for n in nz.CLICK_IDS)}) is null and coalesce(page_referrer, '') = ''"
q("web_touchpoints", f"select *, {sid('att_dedup', 'source', 'medium', 'campaign', 'content', 'term', 'referrer', *nz.CLICK_IDS)} as attribution_deduplication_key, 'web' as touchpoint_type from tattr union all select *, {sid('att_dedup', repr('direct'), 'landing_page')}, 'web' from tdirect")(lambda s, d: web.touchpoints(fx.read(s, d, "segment_events")))

_HALVES = lambda s, d: (lambda e: {"web": e.where("event_type = 'web'").select("id", "received_at", "event_name", "page_url"), "rest": e.where("event_type <> 'web'").select("id", "received_at", "event_name", "user_id")})(fx.read(s, d, "segment_events").where("id is not null"))
C["halves"] = "select id, received_at, event_name, case when event_type = 'web' then page_url end as page_url, case when event_type <> 'web' then user_id end as user_id, case when event_type = 'web' then 'web' else 'rest' end as segment_source from segment_events where id is not null and event_type is not null"
q("web_calls", "select id, segment_source, max(received_at) as received_at from halves where segment_source = 'web' group by 1, 2")(lambda s, d: tb.union_calls(_HALVES(s, d), {"web": ["pages"], "rest": ["tracks"]}, "pages").select("id", "segment_source", "received_at"))
q("web_tracks", "select id, max(received_at) as received_at from halves group by 1")(lambda s, d: tb.union_tracks(_HALVES(s, d)).select("id", "received_at"))
q("web_calls_none", "select * from (select cast(null as varchar) as id, cast(null as timestamp) as received_at) where false")(lambda s, d: tb.union_calls(_HALVES(s, d), {}, "pages", schema="id string, received_at timestamp_ntz", spark=s))
q("unpivot_limited", "select 2000::bigint as n")(lambda s, d: rl.unpivot_identifiers(fx.read(s, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("event_id"), F.lit("e").alias("edge_id"), F.lit("o").alias("source"), F.col("o_orderdate").alias("occurred_at"), F.col("o_orderdate").alias("_ingested_at")), ["o_custkey"], limit=2000, target="dev").agg(F.count("*").alias("n")))

# Mail
_H = lambda n: f"list_filter(hs, lambda h: lower(json_extract_string(h, '$.name')) = '{n}')[1]"
_HV = lambda n: f"json_extract_string({_H(n)}, '$.value')"
_DECODED = _DECODE.replace("coalesce(t, '')", "coalesce(json_extract_string(r, '$.snippet'), '')")
_BULK = "(" + " or ".join(f"coalesce(trim({_HV(n)}), '') <> ''" for n in mail.BULK_MARKS) + f" or coalesce(lower({_HV('precedence')}), '') in ('bulk', 'list', 'junk') or starts_with(coalesce(lower({_HV('auto-submitted')}), ''), 'auto-'))"
C |= {
    "mraw0": "select *, case when json_valid(_raw_record) then case when json_type(_raw_record) = 'VARCHAR' then json_extract_string(_raw_record, '$') else _raw_record end end as r0 from gmail_messages",
    "mraw": "select *, case when json_valid(r0) then r0 end as r from mraw0",
    "mdup": "select * exclude (rn) from (select *, nullif(json_extract_string(r, '$.id'), '') as message_id, row_number() over (partition by nullif(json_extract_string(r, '$.id'), '') order by _ingested_at desc nulls last, _row_id desc) as rn from mraw where nullif(json_extract_string(r, '$.id'), '') is not null) where rn = 1",
    "mhead": "select *, from_json(json_extract(r, '$.headers'), '[\"JSON\"]') as hs, make_timestamp(try_cast(json_extract_string(r, '$.internalDate') as bigint) * 1000) as sent_at from mdup",
    "mmsg": f"select message_id, _account, _stream_id, json_extract_string(r, '$.threadId') as thread_id, {_HV('message-id')} as message_id_header, {_HV('from')} as from_header, {_HV('subject')} as raw_subject, trim(regexp_replace({_HV('subject')}, '^(([Rr][Ee]|[Ff][Ww][Dd]?):\\s*){{1,4}}', '')) as subject, {_DECODED} as snippet, from_json(json_extract(r, '$.labelIds'), '[\"VARCHAR\"]') as label_ids, sent_at, {_BULK} as is_bulk, _ingested_at from mhead",
    "mpraw": " union all ".join(f"select message_id, _account, sent_at, _ingested_at, '{role}' as role, trim(unnest({('string_split(' + _HV(h) + ', ' + chr(39) + ',' + chr(39) + ')') if many else '[' + _HV(h) + ']'})) as t from mhead" for h, role, many in (("from", "sender", False), ("to", "recipient", True), ("cc", "cced", True), ("bcc", "bcced", True))),
    "maddr": "select *, case when contains(t, '<') and contains(t, '>') then regexp_extract(t, '<([^>]+)>', 1) else trim(t) end as a from mpraw where t <> ''",
    "mnorm": "select *, " + _EMAIL_SQL.replace("trim(t)", "trim(a)") + " as email, nullif(trim(regexp_replace(nullif(trim(regexp_extract(t, '^([^<]+)<', 1)), ''), '^[\"'']+|[\"'']+$', '', 'g')), '') as name from maddr",
    "mpart": "select message_id, _account, email, split_part(email, '@', 2) as domain, name, role, sent_at, _ingested_at from (select *, row_number() over (partition by message_id, _account, email, role order by _ingested_at desc nulls last, sent_at desc nulls last, t desc) as rn from mnorm where email is not null) where rn = 1",
    "mxp": "select message_id_header, email, domain, role, name, sent_at, message_id from (select p.*, m.message_id_header, row_number() over (partition by m.message_id_header, email, role order by p.sent_at desc nulls last, p.message_id desc) as rn from mpart p join mmsg m on m.message_id = p.message_id and m._account = p._account where m.message_id_header is not null) where rn = 1",
}
_mdup = lambda s, d: mail.deduped(fx.read(s, d, "gmail_messages"))
_mmsg = lambda s, d: mail.by_account(_mdup(s, d))
_mpart = lambda s, d: mail.participants(_mdup(s, d))
_mxp = lambda s, d: mail.participants_across(_mmsg(s, d), _mpart(s, d))
q("mail_deduped", "select message_id, _row_id, _ingested_at, _account from mdup")(lambda s, d: _mdup(s, d).select("message_id", "_row_id", "_ingested_at", "_account"))
q("mail_messages_by_account", "select * from mmsg")(_mmsg)
q("mail_participants_by_account", "select * from mpart")(_mpart)
_mthr = lambda s, d: mail.threads(_mmsg(s, d))
_mtp = lambda s, d: mail.thread_participants(_mmsg(s, d), _mpart(s, d))
_mtx = lambda s, d: mail.threads_across(_mthr(s, d))
_mtpx = lambda s, d: mail.thread_participants_across(_mtp(s, d), _mthr(s, d))
_HOME = ("nexwick.example",)
_SAME = lambda a, b: f"{a}.thread_id = {b}.thread_id and {a}._account is not distinct from {b}._account and {a}._stream_id is not distinct from {b}._stream_id"
_LABELS = "coalesce(list_sort(list_distinct(flatten(list(label_ids) filter (label_ids is not null)))), [])"
C |= {
    "mone": "select * from (select *, row_number() over (partition by thread_id, _account, _stream_id order by sent_at nulls last, message_id) as rn from mmsg where thread_id is not null) where rn = 1",
    "mgrp": f"select thread_id, _account, _stream_id, count(*) as message_count, min(sent_at) as first_sent_at, max(sent_at) as last_sent_at, {_LABELS} as label_ids, min(_ingested_at) as _ingested_at, max(_ingested_at) as _watermark_ingested_at from mmsg where thread_id is not null group by 1, 2, 3",
    "mthr": f"select g.*, f.subject, f.raw_subject, f.message_id as first_message_id, f.message_id_header as first_message_id_header from mgrp g join mone f on {_SAME('g', 'f')}",
    "mtp": "select m.thread_id, p._account, email, domain, min(p.sent_at) as first_at, max(p.sent_at) as last_at, count(distinct p.message_id) as message_count, list_filter(['sender', 'recipient', 'cced', 'bcced'], lambda r: list_contains(list(distinct role), r)) as roles, arg_min(name, {'t': p.sent_at, 'n': name}) filter (name is not null) as name, max(p._ingested_at) as _watermark_ingested_at from mpart p join mmsg m on m.message_id = p.message_id and m._account = p._account where m.thread_id is not null group by 1, 2, 3, 4",
    "mtop": "select * from (select *, row_number() over (partition by first_message_id_header order by first_sent_at nulls last, _account nulls first, _stream_id nulls first, thread_id) as rn from mthr where first_message_id_header is not null) where rn = 1",
    "mtx": f"select t.first_message_id_header as thread_id, any_value(o.subject) as subject, any_value(o.raw_subject) as raw_subject, min(t.first_sent_at) as first_sent_at, max(t.last_sent_at) as last_sent_at, '{{' || string_agg(to_json(coalesce(t._stream_id, ''))::varchar || ': ' || to_json(t.thread_id)::varchar, ', ' order by t._stream_id nulls first, t.thread_id) || '}}' as thread_ids_by_stream, '{{' || string_agg(to_json(coalesce(t._stream_id, ''))::varchar || ': ' || to_json(t.label_ids)::varchar, ', ' order by t._stream_id nulls first, t.label_ids) || '}}' as labels_by_stream, coalesce(list_sort(list_distinct(flatten(list(t.label_ids)))), []) as all_label_ids, min(t._ingested_at) as _ingested_at, max(t._watermark_ingested_at) as _watermark_ingested_at from mthr t join mtop o on o.first_message_id_header = t.first_message_id_header group by 1",
    "mtpx": "select t.first_message_id_header as thread_id, email, domain, arg_min(p.name, {'t': p.first_at, 'n': p.name}) filter (p.name is not null) as name, list_filter(['sender', 'recipient', 'cced', 'bcced'], lambda r: list_contains(flatten(list(p.roles)), r)) as roles, min(first_at) as first_at, max(last_at) as last_at, max(greatest(p._watermark_ingested_at, t._watermark_ingested_at)) as _watermark_ingested_at from mtp p join mthr t on t.thread_id = p.thread_id and t._account = p._account where t.first_message_id_header is not null group by 1, 2, 3",
}
_WM = "(select make_timestamp(epoch_us(min(_ingested_at)) + (epoch_us(max(_ingested_at)) - epoch_us(min(_ingested_at))) // 4 * 3) from mmsg)"


def _late(m: DataFrame):
    lo, hi = m.agg(F.min("_ingested_at"), F.max("_ingested_at")).first()
    return lo + (hi - lo) // 4 * 3


q("mail_threads", "select * from mthr")(_mthr)
q("mail_thread_participants", "select * from mtp")(_mtp)
q("mail_threads_across", "select * from mtx")(_mtx)
q("mail_thread_participants_across", "select * from mtpx")(_mtpx)
q("mail_touched_threads", f"select distinct first_message_id_header from mthr t where first_message_id_header is not null and (_watermark_ingested_at > {_WM} or exists (select 1 from mtp p where p.thread_id = t.thread_id and p._account = t._account and p._watermark_ingested_at > {_WM}))")(lambda s, d: mail.touched_threads(_mthr(s, d), _mtp(s, d), _late(_mmsg(s, d))))
q("mail_message_participation", f"select m.*, coalesce(n, 0) as participant_count, coalesce(i, 0) as internal_participant_count, coalesce(n - i, 0) as external_participant_count, coalesce(ds, []) as participant_domains, false as is_internal_only from mmsg m left join (select message_id, _account, count(*) as n, count(*) filter (domain in ('{_HOME[0]}')) as i, list_sort(list(distinct domain)) as ds from mpart group by 1, 2) p on p.message_id = m.message_id and p._account = m._account where not (coalesce(n, 0) > 0 and n = i)")(lambda s, d: mail.with_participants(_mmsg(s, d), _mpart(s, d), _HOME, drop_internal_only=True))
_TE = sid("evt", "thread_id", repr("thread started"))
C["mtev"] = f"select {_TE} as event_id, first_sent_at as occurred_at, 'thread started' as event_name, subject as event_description, 'email' as event_type, 0.0::double as significance, 'mail' as source, _watermark_ingested_at as _ingested_at from mtx"
q("mail_thread_events", "select * from mtev")(lambda s, d: mail.thread_events(_mtx(s, d)))
_THREAD_ROWS = lambda rows, et, it: f"select {sid('ent_idfr', 'event_id', 'v', repr(et), 'role')} as entity_identifier_id, event_id, {sid('edg', 'event_id', 'v', repr(et), 'role')} as edge_id, '{et}' as entity_type, '{it}' as identifier_type, v as identifier_value, 'mail' as source, max(occurred_at) as occurred_at, max(_ingested_at) as _ingested_at, role from ({rows}) where (event_id, v, role, _ingested_at) in (select (event_id, v, role, max(_ingested_at)) from ({rows}) group by event_id, v, role) group by event_id, v, role"
C["mtper"] = f"select {_TE} as event_id, email as v, first_at as occurred_at, _watermark_ingested_at as _ingested_at, unnest(roles) as role from mtpx"
C["mtgrp"] = f"select {_TE} as event_id, unnest([domain, case when starts_with(domain, 'www.') then substr(domain, 5) else 'www.' || domain end]) as v, first_at as occurred_at, _watermark_ingested_at as _ingested_at, r.role from mtpx, (select unnest(['sender', 'recipient', 'cced', 'bcced']) as role) r where list_contains(roles, r.role) and domain <> ''"
q("mail_thread_person_identifiers", _THREAD_ROWS("select * from mtper", "person", "email"))(lambda s, d: mail.thread_person_identifiers(_mtpx(s, d)))
q("mail_thread_group_identifiers", _THREAD_ROWS("select * from mtgrp", "group", "domain"))(lambda s, d: mail.thread_group_identifiers(_mtpx(s, d)))
q("mail_thread_first", "select thread_id, _account, _stream_id, subject, message_id as first_message_id from (select *, row_number() over (partition by thread_id, _account, _stream_id order by sent_at nulls last, message_id) as rn from mmsg where thread_id is not null) where rn = 1")(lambda s, d: mail.threads(_mmsg(s, d)).select("thread_id", "_account", "_stream_id", "subject", "first_message_id"))
_mx = lambda s, d: mail.across_accounts(_mmsg(s, d), _mthr(s, d))
C["mx"] = f"select l.message_id_header, l.message_id as latest_message_id, l.subject, t.first_message_id_header as thread_id, l.sent_at, g.is_bulk, g.account_count, g.ids_by_account, g.all_label_ids from (select *, row_number() over (partition by message_id_header order by sent_at desc nulls last, message_id desc) as rn from mmsg where message_id_header is not null) l join (select message_id_header, bool_or(is_bulk) as is_bulk, count(distinct _account) as account_count, '{{' || string_agg(to_json(coalesce(_account, ''))::varchar || ': ' || to_json(message_id)::varchar, ', ' order by _account nulls first, message_id) || '}}' as ids_by_account, {_LABELS} as all_label_ids from mmsg where message_id_header is not null group by 1) g using (message_id_header) left join mthr t on {_SAME('t', 'l')} where l.rn = 1"
q("mail_messages", "select * from mx")(_mx)
q("mail_message_latest", "select message_id_header, message_id as latest_message_id, subject from (select *, row_number() over (partition by message_id_header order by sent_at desc nulls last, message_id desc) as rn from mmsg where message_id_header is not null) where rn = 1")(lambda s, d: mail.across_accounts(_mmsg(s, d)).select("message_id_header", "latest_message_id", "subject"))
q("mail_ids_by_account", "select message_id_header, '{' || string_agg('\"' || coalesce(_account, '') || '\": \"' || message_id || '\"', ', ' order by _account nulls first, message_id) || '}' as ids_by_account from (select distinct message_id_header, _account, message_id from mmsg where message_id_header is not null) group by 1")(lambda s, d: mail.across_accounts(_mmsg(s, d)).select("message_id_header", "ids_by_account"))
q("mail_participants", "select * from mxp")(_mxp)
q("mail_events", f"select {sid('evt', repr('mail'), 'message_id_header')} as event_id, max(sent_at) as occurred_at, case when bool_or(is_bulk) then -10.0::double else 10.0::double end as significance from mmsg where message_id_header is not null group by message_id_header")(lambda s, d: mail.message_events(mail.across_accounts(_mmsg(s, d))).select("event_id", "occurred_at", "significance"))
_EV = sid("evt", repr("mail"), "message_id_header")
q("mail_person_identifiers", f"select distinct {sid('ent_idfr', _EV, 'email', 'role')} as entity_identifier_id, {_EV} as event_id, {sid('edg', _EV, 'email')} as edge_id, 'person' as entity_type, 'email' as identifier_type, email as identifier_value, role, 'mail' as source, sent_at as occurred_at from mxp")(lambda s, d: mail.person_identifiers(_mxp(s, d)))
_TWIN = "select distinct message_id_header, sent_at, unnest([domain, case when starts_with(domain, 'www.') then substr(domain, 5) else 'www.' || domain end]) as value from mxp where domain <> ''"
q("mail_group_identifiers", f"select {sid('ent_idfr', _EV, 'value')} as entity_identifier_id, {_EV} as event_id, {sid('edg', _EV, 'value')} as edge_id, 'group' as entity_type, 'domain' as identifier_type, value as identifier_value, 'organization' as role, 'mail' as source, sent_at as occurred_at from ({_TWIN})")(lambda s, d: mail.group_identifiers(_mxp(s, d)))
q("mail_person_traits", f"select {sid('ent_tr', _EV, 'email', 'n', 'v')} as entity_trait_id, {_EV} as event_id, 'person' as entity_type, 'email' as identifier_type, email as identifier_value, n as trait_name, v as trait_value, sent_at as occurred_at from (select distinct message_id_header, sent_at, email, 'name' as n, name as v from mxp where name is not null union all select distinct message_id_header, sent_at, email, 'email', email from mxp)")(lambda s, d: mail.person_traits(_mxp(s, d)))
q("mail_relationships", f"select {sid('rel_decl', _EV, 'email', 'domain')} as relationship_declaration_id, {_EV} as event_id, sent_at as occurred_at, email as entity_a_identifier, 'member' as entity_a_role, domain as entity_b_identifier, 'organization' as entity_b_role, 'membership' as relationship_type, 'a_to_b' as relationship_direction from (select distinct message_id_header, sent_at, email, domain from mxp where domain <> '')")(lambda s, d: mail.declarations(_mxp(s, d)))
_GT = f"select distinct {sid('ent_tr', _EV, 'domain', repr('group'), repr('domain'))} as entity_trait_id, {_EV} as event_id, 'group' as entity_type, 'domain' as identifier_type, domain as identifier_value, 'domain' as trait_name, domain as trait_value, 'mail' as source, max(sent_at) over (partition by message_id_header, domain) as occurred_at from mxp where domain <> '' and domain not like '%>%'"
q("mail_group_traits", _GT)(lambda s, d: mail.group_traits(_mxp(s, d)))
q("mail_events_all", f"select {_EV} as event_id, sent_at as occurred_at, 'email message' as event_name, subject as event_description, 'email' as event_type, case when is_bulk then -10.0::double else 10.0::double end as significance, 'mail' as source, cast(null as timestamp) as _ingested_at from mx union all select * from mtev")(lambda s, d: mail.layer([mail.message_events(_mx(s, d)), mail.thread_events(_mtx(s, d))]))
q("mail_identifier_counts", f"select 'person' as entity_type, count(*) as n from (select distinct message_id_header, email, role from mxp union all select event_id, v, role from mtper) union all select 'group', count(*) from (select distinct message_id_header, value, sent_at from ({_TWIN}) union all select distinct event_id, v || role, null from mtgrp)")(lambda s, d: mail.layer([mail.person_identifiers(x := _mxp(s, d)), mail.group_identifiers(x), mail.thread_person_identifiers(t := _mtpx(s, d)), mail.thread_group_identifiers(t)]).groupBy("entity_type").agg(F.count("*").alias("n")))
C["braw"] = "select *, case when json_valid(r0) then r0 end as r from (select *, case when json_valid(_raw_record) then case when json_type(_raw_record) = 'VARCHAR' then json_extract_string(_raw_record, '$') else _raw_record end end as r0 from gmail_message_bodies)"
q("mail_bodies", "select * exclude (rn) from (select json_extract_string(r, '$.message_id_header') as message_id_header, cast(try_cast(json_extract_string(r, '$.fetched_at') as timestamptz) as timestamp) as fetched_at, _row_id, json_extract_string(r, '$.gmail_account_email') as account_email, try_cast(json_extract_string(r, '$.body_size_bytes') as bigint) as body_size_bytes, try_cast(json_extract_string(r, '$.body_truncated_at_bytes') as bigint) as body_truncated_at_bytes, coalesce(json_extract_string(r, '$.body_plain'), json_extract_string(r, '$.body_text_from_html')) as body_text, row_number() over (partition by json_extract_string(r, '$.message_id_header') order by cast(try_cast(json_extract_string(r, '$.fetched_at') as timestamptz) as timestamp) desc nulls last, _row_id desc) as rn from braw where json_extract_string(r, '$.message_id_header') is not null) where rn = 1")(lambda s, d: mail.bodies(fx.read(s, d, "gmail_message_bodies")))


# Calendar: envelopes built from orders.
def calendar_raw(s, d) -> DataFrame:
    o = fx.read(s, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    who = F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("@shop.test"))
    body = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('"start": {"date": "'), day, F.lit('"}, "end": {"date": "'), day, F.lit('"}'))).otherwise(F.concat(F.lit('"start": {"dateTime": "'), day, F.lit('T09:00:00+02:00"}, "end": {"dateTime": "'), day, F.lit('T10:00:00+02:00"}')))
    rec = F.when(F.col("o_orderkey") % 5 == 0, F.lit(', "recurringEventId": "r1"')).otherwise("")
    raw = F.concat(F.lit('{"iCalUID": "cal-'), F.col("o_orderkey").cast("string"), F.lit('", "summary": "visit", "status": "confirmed", "organizer": {"email": "Desk@'), F.when(F.col("o_orderkey") % 3 == 0, "out.test").otherwise("shop.test"), F.lit('"}, "attendees": [{"email": "'), who, F.lit('", "displayName": "C", "responseStatus": "accepted"}], '), body, rec, F.lit("}"))
    return o.select(F.col("o_orderdate").alias("_ingested_at"), F.lit("acc").alias("_account"), raw.alias("_raw_record"))


_KEY = "'cal-' || o_orderkey || case when o_orderkey % 5 = 0 then '|' || strftime(o_orderdate, '%Y-%m-%d') || case when o_orderkey % 7 = 0 then '' else 'T09:00:00+02:00' end else '' end"
_CEND = "case when o_orderkey % 7 = 0 then date_trunc('day', o_orderdate) + interval 86399 second else date_trunc('day', o_orderdate) + interval 8 hour end"
C["cev"] = f"select {_KEY} as event_key, 'visit' as summary, 'confirmed' as status, cast(null as varchar) as location, case when o_orderkey % 7 = 0 then date_trunc('day', o_orderdate) else date_trunc('day', o_orderdate) + interval 7 hour end as starts_at, {_CEND} as ends_at, o_orderkey % 7 = 0 as is_all_day, o_orderkey % 5 = 0 as is_recurring, o_orderkey % 3 = 0 as has_external_attendees, 1::bigint as attendee_count, 'acc' as _account, o_orderdate as _ingested_at, {sid('evt', repr('calendar'), _KEY)} as event_id from orders"
C["cpart"] = f"select {_KEY} as event_key, 'attendee' as role, 'cust' || o_custkey || '@shop.test' as email, 'C' as name, 'accepted' as response, 'shop.test' as domain from orders union all select {_KEY}, 'organizer', case when o_orderkey % 3 = 0 then 'desk@out.test' else 'desk@shop.test' end, null, null, case when o_orderkey % 3 = 0 then 'out.test' else 'shop.test' end from orders"
C["ctimed"] = "select p.*, e.event_id, e.starts_at from cpart p join cev e using (event_key)"
C["cgid"] = "select distinct event_id, starts_at, role, unnest([domain, 'www.' || domain]) as value from ctimed"
C["cids"] = f"select {sid('ent_idfr', 'event_id', 'email', 'role')} as entity_identifier_id, event_id, {sid('edg', 'event_id', 'email')} as edge_id, 'person' as entity_type, 'email' as identifier_type, email as identifier_value, role, 'calendar' as source, starts_at as occurred_at from ctimed union all select {sid('ent_idfr', 'event_id', 'value', repr('group'), 'role', 'starts_at')}, event_id, {sid('edg', 'event_id', 'value', repr('group'), 'role')}, 'group', 'domain', value, role, 'calendar', starts_at from cgid"
_CTR = lambda et, it, v, n, *more: f"select distinct {sid('ent_tr', 'event_id', v, repr(et), repr(n), *more)} as entity_trait_id, event_id, '{et}' as entity_type, '{it}' as identifier_type, {v} as identifier_value, '{n}' as trait_name, {n} as trait_value, 'calendar' as source, starts_at as occurred_at from ctimed where {n} is not null"
_cal = lambda s, d: cal.deduped(calendar_raw(s, d))
_cn = lambda s, d: cal.normalized(_cal(s, d), ("shop.test",))
_cp = lambda s, d: cal.participants(_cal(s, d))
q("cal_events", "select * exclude (event_id) from cev")(_cn)
q("cal_participants", "select * from cpart")(_cp)
q("cal_meeting_events", "select event_id, starts_at as occurred_at, case when has_external_attendees then 'external_meeting' else 'internal_meeting' end as event_name, summary as event_description, 'meeting' as event_type, 100.0::double as significance, 'calendar' as source from cev")(lambda s, d: cal.meeting_events(_cn(s, d)))
q("cal_identifiers", "select * from cids")(lambda s, d: rl.union_aligned([cal.person_identifiers(p := _cp(s, d), n := _cn(s, d)), cal.group_identifiers(p, n)]))
q("cal_traits", " union all ".join([_CTR("person", "email", "email", "name", "role"), _CTR("person", "email", "email", "email", "role"), _CTR("group", "domain", "domain", "domain")]))(lambda s, d: rl.union_aligned([cal.person_traits(p := _cp(s, d), n := _cn(s, d)), cal.group_traits(p, n)]))
q("cal_relationships", f"select distinct {sid('rel_decl', 'event_id', 'email', 'domain', repr('member'), 'starts_at')} as relationship_declaration_id, event_id, starts_at as occurred_at, email as entity_a_identifier, 'email' as entity_a_identifier_type, 'person' as entity_a_type, 'member' as entity_a_role, domain as entity_b_identifier, 'domain' as entity_b_identifier_type, 'group' as entity_b_type, 'organization' as entity_b_role, 'membership' as relationship_type, 'a_to_b' as relationship_direction, true as is_active, 'calendar' as source from ctimed")(lambda s, d: cal.declarations(_cp(s, d), _cn(s, d)))

# Plans (semantic layers have the same envelope)
C["sraw"] = "select *, case when json_valid(r0) then r0 end as r from (select *, case when json_valid(_raw_record) then case when json_type(_raw_record) = 'VARCHAR' then json_extract_string(_raw_record, '$') else _raw_record end end as r0 from semantic_layers)"
C["slast"] = "select * exclude (rn) from (select *, json_extract_string(r, '$.organization_id') as organization_id, json_extract_string(r, '$.layer_slug') as slug, json_extract_string(r, '$.content_hash') as content_hash, row_number() over (partition by json_extract_string(r, '$.organization_id'), json_extract_string(r, '$.layer_slug') order by _ingested_at desc nulls last, _row_id desc) as rn from sraw where json_extract_string(r, '$.organization_id') is not null and json_extract_string(r, '$.layer_slug') is not null) where rn = 1"
q("plan_versions", "select l.organization_id, l.slug, l.content_hash, l._ingested_at, l._row_id, s.deliveries, s.version_count, s.first_seen_at from slast l join (select json_extract_string(r, '$.organization_id') as o, json_extract_string(r, '$.layer_slug') as g, count(*) as deliveries, count(distinct json_extract_string(r, '$.content_hash')) as version_count, min(_ingested_at) as first_seen_at from sraw group by 1, 2) s on s.o = l.organization_id and s.g = l.slug")(lambda s, d: pl.versions(fx.read(s, d, "semantic_layers"), "layer_slug", "layer").drop("body"))
q("plan_entries", "select organization_id, slug, i - 1 as position, json_extract_string(ms[i], '$.name') as name, json_extract_string(ms[i], '$.type') as type, json_extract_string(ms[i], '$.expr') as expr from (select organization_id, slug, ms, unnest(generate_series(1, len(ms))) as i from (select organization_id, slug, from_json(json_extract(r, '$.layer.metrics'), '[\"JSON\"]') as ms from slast))")(lambda s, d: pl.entries(pl.versions(fx.read(s, d, "semantic_layers"), "layer_slug", "layer"), "metrics", ["name", "type", "expr"]))
q("meta_metrics", "select organization_id, slug as layer_slug, i - 1 as position, json_extract_string(ms[i], '$.name') as metric_name, json_extract_string(ms[i], '$.label') as metric_label, json_extract_string(ms[i], '$.type') as metric_type, json_extract_string(ms[i], '$.expr') as metric_expr from (select organization_id, slug, ms, unnest(generate_series(1, len(ms))) as i from (select organization_id, slug, from_json(json_extract(r, '$.layer.metrics'), '[\"JSON\"]') as ms from slast))")(
    lambda s, d: md.metrics_metadata(fx.read(s, d, "semantic_layers").withColumn("_p", payload(F.col("_raw_record"))).select(F.try_variant_get("_p", "$.organization_id", "string").alias("organization_id"), F.try_variant_get("_p", "$.layer_slug", "string").alias("layer_slug"), F.try_variant_get("_p", "$.layer", "variant").alias("layer"), F.col("_ingested_at").alias("_at"), "_row_id").where("organization_id is not null and layer_slug is not null"))
)


# Incremental
def incremental(s, d, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """The state and log after the web identifiers arrive in slices of the ingestion time."""
    ids = fx.web_identifiers(s, d)
    lo, hi = ids.agg(F.min("_ingested_at"), F.max("_ingested_at")).first()
    cuts = [lo + (hi - lo) * i / parts for i in range(1, parts)] + [hi]
    state = inc.cut(inc.full_state(ids.where(F.col("_ingested_at") <= F.lit(cuts[0])), "person")).df
    logs = []
    for c in cuts[1:]:
        state, log = inc.resolve_batch(state, ids.where(F.col("_ingested_at") <= F.lit(c)), "person")
        state = inc.cut(state).df
        logs.append(log)
    return state, reduce(DataFrame.unionByName, logs)


C["web_fix"] = "select m.identifier_type, m.identifier_value, min(m.identifier_type || ':' || m.identifier_value) over (partition by m.entity_id) as least_id from webf m"


def _fixpoint() -> None:
    from idloom.plans.sql import _hops

    _hops("web_ids", "person", 9, "webf")


_fixpoint()


@q("incremental_partition", "select * from web_fix")
def incremental_partition(s, d) -> DataFrame:
    """Which identifiers are together after all slices: each with the least identifier of its entity."""
    state, _ = incremental(s, d)
    least = state.groupBy("entity_id").agg(F.min(F.concat("identifier_type", F.lit(":"), "identifier_value")).alias("least_id"))
    return state.join(least, "entity_id").select("identifier_type", "identifier_value", "least_id")


def _slices(parts: int = 4) -> str:
    """SQL: the components at the end of each slice, and from them what each slice bore, took in and moved."""
    from idloom.plans.sql import _hops

    steps = []
    for i in range(1, parts + 1):
        C[f"slice{i}"] = f"select * from web_ids where _ingested_at <= (select make_timestamp(epoch_us(min(_ingested_at)) + (epoch_us(max(_ingested_at)) - epoch_us(min(_ingested_at))) * {i} // {parts}) from web_ids)"
        _hops(f"slice{i}", "person", 9, f"slicef{i}")
        if i > 1:
            C[f"slicej{i}"] = f"select n.entity_id as comp, o.entity_id as old from slicef{i} n left join slicef{i - 1} o using (identifier_type, identifier_value)"
            C[f"slices{i}"] = f"select comp, old, count(*) as n from slicej{i} group by 1, 2"
            C[f"slicec{i}"] = f"select comp, coalesce(sum(n) filter (where old is null), 0) as fresh, coalesce(sum(n) filter (where old is not null), 0) as known, coalesce(max(n) filter (where old is not null), 0) as kept from slices{i} group by 1"
            steps.append(f"select sum(case when known = 0 then fresh else 0 end) as born, sum(case when known > 0 then fresh else 0 end) as accreted, sum(known - kept) as repointed from slicec{i}")
    return " union all ".join(steps)


C["slice_sums"] = _slices()
q("incremental_log_counts", "select * from (select 'born' as resolution_reason, sum(born)::bigint as n from slice_sums union all select 'accreted', sum(accreted)::bigint from slice_sums union all select 'repointed', sum(repointed)::bigint from slice_sums) where n > 0")(lambda s, d: incremental(s, d)[1].groupBy("resolution_reason").agg(F.count("*").alias("n")))
_MID = "(select make_timestamp(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2) from events)"
q("touched_rollup", f"select user_id, count(*) as n, max(ts) as _watermark_ingested_at from events where user_id in (select user_id from events where ts > (select max(ts) from events where ts <= {_MID})) group by 1")(
    lambda s, d: (lambda e: inc.touched_groups(e, e.where(F.unix_micros(F.col("_ingested_at").cast("timestamp")) <= F.lit(_mid(e))).groupBy("user_id").agg(F.max("_ingested_at").alias("_watermark_ingested_at")), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.max("_ingested_at").alias("_watermark_ingested_at")))(fx.read(s, d, "events").select("user_id", F.col("ts").alias("_ingested_at")))
)
q("upsert_latest", "select o_custkey, max(o_orderdate) as _ingested_at from orders group by 1")(lambda s, d: (lambda o: inc.upsert(rl.latest(o.where("o_orderkey % 2 = 0"), ["o_custkey"], ["_ingested_at"]), o, ["o_custkey"]))(fx.read(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("_ingested_at"))).select("o_custkey", "_ingested_at"))


def _mid(e: DataFrame) -> int:
    lo, hi = e.select(F.unix_micros(F.col("_ingested_at").cast("timestamp")).alias("u")).agg(F.min("u"), F.max("u")).first()
    return lo + (hi - lo) // 2


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL

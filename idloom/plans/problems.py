"""Queries of the general data-processing problems over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.payload import get_text, payload
from idloom.functions.text import micros, norm_text
from idloom.operators.deliveries import surplus_rows, take_batches
from idloom.operators.packed import explode_packed, split_addresses, split_values
from idloom.operators.sessions import sessionize
from idloom.operators.shred import BARE_LISTS, entity_rows, entity_table
from idloom.operators.snapshots import fingerprints, snapshot_changes

#: Production parameters.
SESSION_GAP_US = 1_800_000_000
FIRST_TIME = "1900-01-01 00:00:00"
ADDRESS_HEADERS = ("to", "cc", "bcc")
TAG_HEADERS = ("keywords",)
PAYLOADS = (("gmail_messages", "_raw_record"), ("stripe_payments_raw_demo", "data"), ("shopify_shops_raw_demo", "record"))


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def messages_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """gmail_messages with the message ``id`` of the payload as text (``_key``); null, empty and missing ids are null."""
    key = get_text(payload(F.col("_raw_record")), "$.id")
    return _read(spark, sf, "gmail_messages").select("_row_id", "_ingested_at", F.when(key != "", key).alias("_key"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return surplus_rows(messages_keyed(spark, sf), "_row_id", "_key", "_ingested_at")


def p3_seen_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The disjoint seen ranges of the producer-sequence identifiers after all batches."""
    return take_batches(messages_keyed(spark, sf), "_row_id", "_key", "_ingested_at").ranges


def p4_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with their duration."""
    e = _read(spark, sf, "segment_events").where(F.col("occurred_at") > F.lit(FIRST_TIME).cast("timestamp_ntz"))
    e = e.select(norm_text(F.col("anonymous_id")).alias("anonymous_id"), micros(F.col("occurred_at")).alias("us"), "event_id")
    return sessionize(e, "anonymous_id", "us", SESSION_GAP_US, "event_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_sessions(spark, sf).select("anonymous_id", "start_us", "end_us", "n_events")


def message_headers(spark: SparkSession, sf: str) -> DataFrame:
    """(_row_id, header_index, name, text): the headers of the readable messages; name in lower case."""
    m = _read(spark, sf, "gmail_messages").select("_row_id", F.try_variant_get(payload(F.col("_raw_record")), "$.headers", "array<variant>").alias("_h"))
    h = m.select("_row_id", F.posexplode("_h").alias("header_index", "_x"))
    value = F.when(F.schema_of_variant(F.try_variant_get("_x", "$.value", "variant")) == "STRING", F.try_variant_get("_x", "$.value", "string"))
    return h.select("_row_id", F.col("header_index").cast("bigint").alias("header_index"), F.lower(F.try_variant_get("_x", "$.name", "string")).alias("name"), value.alias("text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    h = message_headers(spark, sf).where(F.col("name").isin(*ADDRESS_HEADERS, *TAG_HEADERS) & F.col("text").isNotNull())
    values = F.when(F.col("name").isin(*TAG_HEADERS), split_values(F.col("text"))).otherwise(split_addresses(F.col("text")))
    return explode_packed(h, values).select("_row_id", "header_index", "pos", "value")


def layer_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = _read(spark, sf, "semantic_layers").select("_row_id", "_queued_at", "_ingested_at", "_raw_record")
    return fingerprints(s, "_raw_record", ["organization_id", "layer_slug"], "layer", ["metrics", "dimensions"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    c = snapshot_changes(layer_rows(spark, sf), "organization_id", "layer_slug", "_ingested_at", "_print", ["_queued_at", "_row_id"])
    return c.select("organization_id", "layer_slug", micros(F.col("_ingested_at")).alias("snapshot_us"), "change")


def payload_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of every flat table of the three payload tables."""
    return reduce(DataFrame.unionByName, [entity_rows(_read(spark, sf, t), "_row_id", c).select(F.lit(t).alias("source_table"), "*") for t, c in PAYLOADS])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of the rows of all flat tables but the roots'. The cells stay part of the plan: a row is the join of its
    object with its scalars."""
    return payload_entities(spark, sf).where("entity <> '$'").select("source_table", "_row_id", "node_path", "parent_path")


#: The flat tables: name -> (source table, list paths, columns).
FLAT = {
    "p7_headers": ("gmail_messages", "headers", ["name", "value"]),
    "p7_parts": ("gmail_messages", "parts", {"part_id": "partId", "mime_type": "mimeType", "filename": "filename"}),
    "p7_charges": ("stripe_payments_raw_demo", "$.charges.data[]", ["id", "object", "amount", "currency", "captured"]),
    "p7_refunds": ("stripe_payments_raw_demo", "$.charges.data[].refunds.data[]", ["id", "amount", "reason"]),
    "p7_adjustments": ("stripe_payments_raw_demo", "adjustments", ["code", "amount"]),
    "p7_disputes": ("stripe_payments_raw_demo", "disputes", ["id", "status"]),
    "p7_evidence_files": ("stripe_payments_raw_demo", "$.charges.data[].disputes[].evidence.files[]", ["name", "pages"]),
    "p7_attempts": ("stripe_payments_raw_demo", "$.last_payment_error.attempts[]", ["at", "ok"]),
    "p7_line_items": ("stripe_payments_raw_demo", "$.line_items.data[]", ["id", "quantity"]),
    "p7_tiers": ("stripe_payments_raw_demo", "tiers", ["up_to", "unit_amount"]),
    "p7_taxes": ("stripe_payments_raw_demo", "taxes", ["amount"]),
    "p7_locations": ("shopify_shops_raw_demo", "locations", ["id"]),
    "p7_hours": ("shopify_shops_raw_demo", "hours", {"day": "day", "opens": "open", "closes": "close"}),
    "p7_regions": ("shopify_shops_raw_demo", "regions", ["code"]),
    "p7_rates": ("shopify_shops_raw_demo", "rates", ["name", "pct"]),
    "p7_flags": ("shopify_shops_raw_demo", "flags", {"key": "key", "is_on": "on"}),
    "p7_webhook_deliveries": ("shopify_shops_raw_demo", "deliveries", ["at", "code"]),
}


def flat_table(name: str):
    """The query of one flat table, each row pointing to its parent."""
    table, lists, columns = FLAT[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return entity_table(entity_rows(_read(spark, sf, table), "_row_id", dict(PAYLOADS)[table]), "_row_id", lists, columns)

    return run


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_seen_ranges, p4_found, p4_sessions, p5_found, p6_found, p7_found)} | {n: flat_table(n) for n in FLAT}


_KEYED = """
with outer_text as (
  select _row_id, _ingested_at, case when json_valid(_raw_record) then
    case when json_type(_raw_record) = 'VARCHAR' then json_extract_string(_raw_record, '$') else _raw_record end end as r
  from gmail_messages),
keyed as (select _row_id, _ingested_at, case when json_valid(r) then json_extract_string(r, '$.id') end as k from outer_text)
"""

_VISITS = """
with e as (
  select event_id, min(epoch_us(occurred_at)) as us, min(lower(trim(anonymous_id, E' \\t\\n\\r'))) as device
  from segment_events
  where occurred_at > timestamp '1900-01-01 00:00:00'
    and lower(trim(anonymous_id, E' \\t\\n\\r')) not in ('', 'null', 'none')
  group by event_id),
f as (select *, case when us - lag(us) over (partition by device order by us) <= 1800000000 then 0 else 1 end as opens from e),
g as (select *, sum(opens) over (partition by device order by us rows unbounded preceding) as visit from f)
"""


#: A layer's canonical form by SQL: its leaves by path, entries of metrics and dimensions as sorted texts of theirs.
_LAYERS = r"""
with raw0 as (select *, case when json_valid(_raw_record) then case when json_type(_raw_record) = 'VARCHAR' then json_extract_string(_raw_record, '$') else _raw_record end end as j0 from semantic_layers),
raw as (select *, case when json_valid(j0) then j0 end as j from raw0),
keyed as (select _row_id, _queued_at, _ingested_at as ts, json_extract_string(j, '$.organization_id') as org, json_extract_string(j, '$.layer_slug') as slug, json_extract(j, '$.layer') as layer from raw where j is not null),
leaf0 as (select _row_id, fullkey as k, type as t, atom as a from keyed, json_tree(layer)),
leaf as (select *, regexp_extract(k, '^\$\.(metrics|dimensions)\[\d+\]', 1) as l, regexp_extract(k, '^\$\.(?:metrics|dimensions)\[(\d+)\]', 1) as i, regexp_replace(k, '^\$\.(?:metrics|dimensions)\[\d+\]', '') as rel,
  case when t = 'VARCHAR' then 's' || json_extract_string(a, '$') when a is not null and t not in ('BOOLEAN', 'NULL') then 'n' || cast(cast(cast(a as varchar) as double) as varchar) when t = 'BOOLEAN' then cast(a as varchar) else t end as v
  from leaf0 where not (k = '$' and t = 'NULL')),
entry as (select _row_id, l, i, string_agg(rel || '=' || v, chr(2) order by rel, v) as e from leaf where l <> '' group by 1, 2, 3),
packed as (select _row_id, l, string_agg(e, chr(3) order by e) as e from entry group by 1, 2),
parts as (select _row_id, string_agg(e, chr(4) order by l) as p from (select _row_id, l || ':' || e as e, l from packed union all select _row_id, string_agg(k || '=' || v, chr(2) order by k, v), '' from leaf where l = '' group by 1) x group by 1),
versions as (select org, slug, ts, coalesce(p, '') as c from (select k.*, p.p, row_number() over (partition by org, slug, ts order by _queued_at desc nulls last, k._row_id desc) as n from keyed k left join parts p on p._row_id = k._row_id where org is not null and slug is not null and ts is not null) where n = 1),
line as (select org, ts, lag(ts) over (partition by org order by ts) as before from (select distinct org, ts from versions)),
now as (select v.*, l.before from versions v join line l on l.org = v.org and l.ts = v.ts where l.before is not null),
old as (select v.org, v.slug, v.c, l.ts as later from versions v join line l on l.org = v.org and l.before = v.ts)
select coalesce(n.org, o.org) as organization_id, coalesce(n.slug, o.slug) as layer_slug, epoch_us(coalesce(n.ts, o.later)) as snapshot_us,
  case when o.org is null then 'added' when n.org is null then 'removed' else 'changed' end as change
from now n full join old o on n.org = o.org and n.slug = o.slug and n.ts = o.later where o.org is null or n.org is null or n.c <> o.c
"""


#: Address lists and tags by SQL: quoted spans and comments are removed instead of masked.
_PACKED = r"""
with raw0 as (select _row_id, case when json_valid(_raw_record) then case when json_type(_raw_record) = 'VARCHAR' then json_extract_string(_raw_record, '$') else _raw_record end end as r from gmail_messages),
lists as (select _row_id, from_json(json_extract(r, '$.headers'), '["JSON"]') as hs from raw0 where json_valid(r)),
heads as (select _row_id, unnest(range(len(hs))) as header_index, unnest(hs) as h from lists),
texts as (select _row_id, header_index, lower(json_extract_string(h, '$.name')) as name, json_extract_string(h, '$.value') as t from heads where json_type(h, '$.value') = 'VARCHAR'),
tags as (select _row_id, header_index, list_transform(regexp_extract_all(t, '(?:"[^"]*"|[^,;|\t\r\n"]|")+'), lambda x: trim(x, E' \t\n\r')) as vs from texts where name = 'keywords'),
plain0 as (select _row_id, header_index, regexp_replace(t, '"[^"\\]*(?:\\.[^"\\]*)*"', chr(1), 'g') as t from texts where name in ('to', 'cc', 'bcc')),
plain1 as (select _row_id, header_index, """ + "regexp_replace(" * 5 + "t" + r""", '\((?:[^()\\]|\\.)*\)', '', 'g')""" * 5 + r""" as t from plain0),
pieces as (select _row_id, header_index, regexp_extract_all(regexp_replace(t, '[\r\n]+[ \t]+', ' ', 'g'), '(?:<[^<>]*>|[^,;|\r\n])+') as ps from plain1),
entries as (select _row_id, header_index, list_transform(ps, lambda p: case when len(list_filter(regexp_extract_all(p, '<([^<>]*)>', 1), lambda x: contains(x, '@'))) > 0
  then list_transform(list_filter(regexp_extract_all(p, '<([^<>]*)>', 1), lambda x: contains(x, '@')), lambda x: trim(x, E' \t\n\r'))
  else list_filter(regexp_extract_all(regexp_replace(p, '^[^:@]*:', ''), '[^\s<>()\[\],;:@"]*@[^\s<>()\[\],;:@"]+'), lambda x: not starts_with(x, '@')) end) as es from pieces),
found as (select _row_id, header_index, list_transform(list_filter(vs, lambda v: v <> '' and v <> '""'), lambda v: case when len(v) >= 2 and starts_with(v, '"') and ends_with(v, '"') then replace(v[2:-2], '""', '"') else v end) as vs from tags
  union all select _row_id, header_index, list_transform(flatten(es), lambda x: lower(x)) from entries)
select _row_id, header_index, unnest(range(1, len(vs) + 1)) as pos, unnest(vs) as value from found where len(vs) > 0
"""


def _tree(tables: tuple[tuple[str, str], ...]) -> str:
    """The element objects of the payloads by SQL: (source_table, _row_id, node_path, parent_path, entity, value)."""
    docs = " union all ".join(f"select '{t}' as t, _row_id, case when json_type({c}) = 'VARCHAR' then json_extract_string({c}, '$') else {c} end as j from {t} where json_valid({c})" for t, c in tables)
    bare = "|".join(BARE_LISTS)
    fix = rf"'(\.(?:{bare}))(\.|$)', '\1[0]\2', 'g'"
    return rf"""
with docs as ({docs}),
tree as (select t, _row_id, replace(fullkey, '"', '') as p, key, x.value as v from docs, json_tree(case when json_valid(j) then j end) x where x.type = 'OBJECT'),
found as (select t as source_table, _row_id, regexp_replace(regexp_replace(p, {fix}), {fix}) as node_path, v from tree where regexp_matches(p, '\]$|\.({bare})$')),
nodes as (select *, coalesce(nullif(regexp_extract(regexp_replace(node_path, '\[\d+\]$', ''), '^(.*\])', 1), ''), '$') as parent_path, regexp_replace(node_path, '\[\d+\]', '[]', 'g') as entity from found)
"""


def _flat_sql(name: str) -> str:
    table, lists, columns = FLAT[name]
    cols = columns if isinstance(columns, dict) else {c: c for c in columns}
    cells = ", ".join(f"json_extract_string(v, '$.{p}') as {c}" for c, p in cols.items())
    hit = f"entity = '{lists}'" if lists.startswith("$") else f"entity like '%.{lists}[]'"
    return _tree(((table, dict(PAYLOADS)[table]),)) + f"select _row_id, node_path, parent_path, {cells} from nodes where {hit}"


def oracle_sql() -> dict[str, str]:
    return {n: _flat_sql(n) for n in FLAT} | {
        "p5_found": _PACKED,
        "p6_found": _LAYERS,
        "p7_found": _tree(PAYLOADS) + "select source_table, _row_id, node_path, parent_path from nodes",
        "p3_found": _KEYED + """select _row_id from (
  select _row_id, row_number() over (partition by k order by _ingested_at desc nulls last, _row_id desc) as n
  from keyed where k is not null and k <> '') where n > 1""",
        "p3_seen_ranges": _KEYED + """, s as (
  select distinct case when regexp_full_match(k, '[0-9a-f]{16}') then 'x' || substr(k, 1, 4) else 'd' || substr(k, 1, length(k) - 9) end as producer,
    case when regexp_full_match(k, '[0-9a-f]{16}') then cast('0x' || substr(k, 5) as bigint) else cast(substr(k, length(k) - 8) as bigint) end as number
  from keyed where regexp_full_match(k, '[1-9][0-9]{9,29}|[0-9a-f]{16}')),
i as (select producer, number, number // 65536 as chunk,
  number - row_number() over (partition by producer, number // 65536 order by number) as island from s)
select producer, chunk, min(number) as lo, max(number) as hi from i group by producer, chunk, island""",
        "p4_found": _VISITS + "select device as anonymous_id, min(us) as start_us, max(us) as end_us, count(*) as n_events from g group by device, visit",
        "p4_sessions": _VISITS + "select device as anonymous_id, min(us) as start_us, max(us) as end_us, max(us) - min(us) as duration_us, count(*) as n_events from g group by device, visit",
    }

"""DuckDB SQL of the fixtures and shared steps, put before a query's own SQL as far as it uses them."""

from __future__ import annotations

import re

NULL = "_dbt_utils_surrogate_key_null_"


def key(*parts: str) -> str:
    return "md5(concat_ws('-', " + ", ".join(f"coalesce(cast({p} as varchar), '{NULL}')" for p in parts) + "))"


def sid(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || {key(*parts)}"


def _ids(src: str, kind: str, value: str, entity: str, role: str, source: str, at: str, where: str = "true") -> str:
    return f"select {sid('ent_idfr', 'eid', value, repr(kind))} as entity_identifier_id, eid as event_id, eid as edge_id, '{entity}' as entity_type, '{kind}' as identifier_type, cast({value} as varchar) as identifier_value, '{role}' as role, '{source}' as source, {at} as occurred_at, {at} as _ingested_at from {src} where {where}"


def _decl(src: str, k: str, at: str, active: str) -> str:
    return f"select {sid('rel_decl', *k.split('|'))} as relationship_declaration_id, {sid('evt', *k.split('|'))} as event_id, {at} as occurred_at, cast(c_custkey as varchar) as entity_a_identifier, 'customer_key' as entity_a_identifier_type, 'person' as entity_a_type, 'member' as entity_a_role, cast(c_nationkey as varchar) as entity_b_identifier, 'nation_key' as entity_b_identifier_type, 'group' as entity_b_type, 'organization' as entity_b_role, 'membership' as relationship_type, 'a_to_b' as relationship_direction, {active} as is_active, 'crm' as source from {src}"


_ENDS = "entity_type_a, identifier_type_a, identifier_value_a, entity_type_b, identifier_type_b, identifier_value_b"


def _edges(ids: str) -> str:
    return f"""select edge_id, {_ENDS}, source, _ingested_at, {key(*_ENDS.split(', '))} as edge_uniqueness_hash from (
  select *, row_number() over (partition by {_ENDS} order by _ingested_at nulls first, edge_id, source nulls first) as rn from (
    select a.edge_id, a.entity_type as entity_type_a, a.identifier_type as identifier_type_a, a.identifier_value as identifier_value_a, b.entity_type as entity_type_b, b.identifier_type as identifier_type_b, b.identifier_value as identifier_value_b, a.source, a._ingested_at
    from {ids} a join (select distinct edge_id, entity_type, identifier_type, identifier_value from {ids}) b on a.edge_id = b.edge_id
    where a.identifier_value is not null and b.identifier_value is not null and (a.entity_type <> b.entity_type or a.identifier_type <> b.identifier_type or a.identifier_value <> b.identifier_value))) where rn = 1"""


C: dict[str, str] = {
    "raw_ev": f"select *, cast(json_extract_string(props, '$.k') as bigint) as k, {sid('evt', 'event_id')} as eid from events",
    "web_ev": "select eid as event_id, ts as occurred_at, event_type as event_name, event_type || ' event' as event_description, 'web' as event_type, cast(case when event_type = 'purchase' then 10 else 0 end as double) as significance, 'web' as source, 'events' as source_table, ts as _ingested_at from raw_ev",
    "order_ev": f"select {sid('evt', repr('order'), 'o_orderkey')} as event_id, o_orderdate as occurred_at, 'order placed' as event_name, cast(null as varchar) as event_description, 'order' as event_type, cast(5 as double) as significance, 'orders' as source, 'orders' as source_table, o_orderdate as _ingested_at from orders",
    "cust": f"select c.*, coalesce(o.at0, timestamp '1990-01-01') as seen_at, {sid('evt', repr('customer'), 'c_custkey')} as eid from customer c left join (select o_custkey, min(o_orderdate) as at0 from orders group by 1) o on c.c_custkey = o.o_custkey",
    "crm_ev": "select eid as event_id, seen_at as occurred_at, 'customer created' as event_name, cast(null as varchar) as event_description, 'crm' as event_type, cast(1 as double) as significance, 'crm' as source, 'customer' as source_table, seen_at as _ingested_at from cust",
    "all_ev": "select * from web_ev union all select * from order_ev union all select * from crm_ev",
    "web_ids": " union all ".join([_ids("raw_ev", "user_id", "user_id", "person", "visitor", "web", "ts"), _ids("raw_ev", "anonymous_id", "'anon-' || user_id || '-' || (k % 3)", "person", "visitor", "web", "ts"), _ids("raw_ev", "email", "'user' || (user_id % 50) || '@shop.test'", "person", "visitor", "web", "ts", "event_type = 'signup' and k < 5")]),
    "noisy_ids": "select * from web_ids union all " + _ids("raw_ev", "device", "'dev-' || k", "person", "visitor", "web", "ts", "event_type = 'error'"),
    "cust_ids": " union all ".join([_ids("cust", "customer_key", "c_custkey", "person", "customer", "crm", "seen_at"), _ids("cust", "name", "c_name", "person", "customer", "crm", "seen_at"), _ids("cust", "nation_key", "c_nationkey", "group", "nation", "crm", "seen_at")]),
    "cust_traits": " union all ".join(f"select {sid('ent_tr', 'eid', repr(n))} as entity_trait_id, eid as event_id, 'person' as entity_type, 'customer_key' as identifier_type, cast(c_custkey as varchar) as identifier_value, '{n}' as trait_name, {v} as trait_value, 'crm' as source, seen_at as occurred_at from cust" for n, v in (("name", "c_name"), ("Market Segment", "c_mktsegment"))),
    "decl": _decl("cust", "'customer'|c_custkey", "seen_at", "true") + " union all " + _decl("orders join cust on o_custkey = c_custkey", "'order'|o_orderkey", "o_orderdate", "o_orderstatus <> 'F'"),
    "ord": f"select *, {sid('evt', repr('order'), 'o_orderkey')} as eid from orders",
    "dims": " union all ".join(f"select {sid('evt_dim', 'eid', repr(n))} as event_dimension_id, eid as event_id, '{n.lower()}' as dimension_name, {v} as dimension_value, o_orderdate as occurred_at, 'orders' as source, o_orderdate as _ingested_at from ord" for n, v in (("Priority", "o_orderpriority"), ("is_urgent", "cast(o_orderpriority like '1-%' as varchar)"))),
    "ordq": "select ord.*, q from ord join (select l_orderkey, sum(l_quantity) as q from lineitem group by 1) on l_orderkey = o_orderkey",
    "msrs": " union all ".join(f"select {sid('evt_msr', 'eid', repr(n))} as event_measurement_id, eid as event_id, '{n.lower()}' as measurement_name, {v} as value, '{u}' as value_unit, o_orderdate as occurred_at, 'orders' as source, o_orderdate as _ingested_at from {t}" for n, v, u, t in (("Revenue", "o_totalprice", "usd", "ord"), ("Quantity", "q", "count", "ordq"))),
    "uparts": "select eid as event_id, 'user-' || user_id as entity_id, 'person' as entity_type, 'visitor' as role, ts as occurred_at from raw_ev",
    "ustate0": "select 'user-' || user_id as entity_id, 'person' as entity_type, event_type, round(value, 2) as value, ts as state_entered_at, lead(ts) over (partition by user_id order by ts, event_id) as state_exited_at, eid as trigger_event_id from raw_ev",
    "ustates0": "select entity_id, entity_type, 'web_activity' as state_name, event_type as state_value, cast(null as double) as state_numeric_value, 'dimension' as state_category, state_entered_at, state_exited_at, state_exited_at is null as is_current, trigger_event_id from ustate0 union all select entity_id, entity_type, 'web_value', null, value, 'measurement', state_entered_at, state_exited_at, state_exited_at is null, trigger_event_id from ustate0",
    "ustates": f"select {sid('st', 'entity_id', 'state_name', 'state_value', 'state_entered_at')} as state_id, * from ustates0",
    "touch0": f"select {sid('tch', 'eid', 'ts')} as touchpoint_id, eid as touchpoint_event_id, ts as occurred_at, 's' || (k % 5) as source, 'm' || (k % 2) as medium, 'c' || (k % 7) as campaign, case when k % 2 = 0 then 'paid' else 'social' end as channel, case when k % 10 = 0 then 'g' || k end as gclid, case when k % 10 = 1 then 'f' || k end as fbclid, case when k % 10 = 2 then 't' || k end as ttclid, case when k % 10 = 3 then 'l' || k end as li_fat_id, case when k % 10 = 4 then 'https://shop.test/?rdt_cid=r' || k when k % 10 = 5 then 'https://shop.test/?rdclid=q' || k else 'https://shop.test/' end as landing_url from raw_ev where event_type = 'click'",
    "touch": f"select *, case when source = 's3' then 'store' else 'web' end as touchpoint_type, {sid('att_dedup', 'source', 'medium', 'campaign')} as attribution_deduplication_key from touch0",
    "web_edges": _edges("web_ids"),
    "noisy_edges": _edges("noisy_ids"),
    # attribution
    "tp1": "select t.touchpoint_id, t.touchpoint_event_id, t.attribution_deduplication_key, t.occurred_at as t, p.entity_id, p.entity_type from touch t join (select distinct event_id, entity_id, entity_type from uparts) p on p.event_id = t.touchpoint_event_id",
    "tp2": "select * from (select *, lag(attribution_deduplication_key) over (partition by entity_id, entity_type order by t, touchpoint_id) as prev from tp1) where prev is null or attribution_deduplication_key is null or prev <> attribution_deduplication_key",
    "tp3": "select u.event_id, u.entity_id, u.entity_type, u.occurred_at as et, max(t.t) as t from (select distinct event_id, entity_id, entity_type, occurred_at from uparts) u join tp2 t on t.entity_id = u.entity_id and t.entity_type = u.entity_type and t.t <= u.occurred_at group by all having date_diff('day', max(t.t), u.occurred_at) <= 90",
    "tp4": "select h.event_id, h.entity_id, h.entity_type, h.et, h.t, t.touchpoint_id, t.touchpoint_event_id, t.attribution_deduplication_key, row_number() over (partition by h.event_id order by t.touchpoint_id, h.entity_type, h.entity_id) as rn from tp3 h join tp2 t on t.entity_id = h.entity_id and t.entity_type = h.entity_type and t.t = h.t",
    "paths": f"select {sid('tch_path', 'event_id', 'entity_id', 'entity_type', 'touchpoint_id')} as touchpoint_path_id, {sid('tch_batch', 'touchpoint_id', 'entity_id', 'entity_type')} as touchpoint_batch_id, touchpoint_id as last_touchpoint_id, event_id, entity_id, entity_type, touchpoint_event_id, attribution_deduplication_key, t as touchpoint_occurred_at, et as event_occurred_at from tp4 where rn = 1",
    "batches": "select b.*, t.* exclude (touchpoint_id) from (select touchpoint_batch_id, last_touchpoint_id as touchpoint_id, entity_id, entity_type, count(*) as events_in_batch, min(event_occurred_at) as first_event_at, max(event_occurred_at) as last_event_at from paths group by 1, 2, 3, 4) b join touch t using (touchpoint_id)",
    "pev": "select distinct entity_id, event_id as attributed_event_id, occurred_at as attributed_event_occurred_at from uparts where entity_type = 'person'",
    "pb": "select entity_id, touchpoint_batch_id, occurred_at, source, medium, campaign, channel from batches where entity_type = 'person' and touchpoint_type = 'web'",
    "ft": "select b.* from pb b join (select entity_id, min(occurred_at) as m from pb group by 1) x on x.entity_id = b.entity_id and x.m = b.occurred_at",
    "first_t": f"select a.entity_id, a.occurred_at as touchpoint_occurred_at, a.touchpoint_batch_id, a.source, a.medium, a.campaign, a.channel, e.attributed_event_id, e.attributed_event_occurred_at, 'first_marketing_touch' as attribution_model_name, {sid('attr_res', repr('first_marketing_touch'), 'a.touchpoint_batch_id', 'attributed_event_id', 'a.entity_id')} as attribution_model_result_id from ft a join ft b on a.entity_id = b.entity_id join pev e on e.entity_id = a.entity_id and e.attributed_event_occurred_at >= a.occurred_at",
    "last_t": f"select entity_id, occurred_at as touchpoint_occurred_at, touchpoint_batch_id, source, medium, campaign, channel, attributed_event_id, attributed_event_occurred_at, 'last_marketing_touch' as attribution_model_name, {sid('attr_res', repr('last_marketing_touch'), 'touchpoint_batch_id', 'attributed_event_id', 'entity_id')} as attribution_model_result_id from (select e.*, b.* exclude (entity_id), row_number() over (partition by attributed_event_id order by b.occurred_at desc, b.touchpoint_batch_id desc, e.entity_id desc) as rn from pev e join pb b on b.entity_id = e.entity_id and b.occurred_at <= e.attributed_event_occurred_at) where rn = 1",
}


def click_sql(column: str, value: str) -> str:
    return f"""select p.touchpoint_batch_id, p.entity_id, p.entity_type, p.touchpoint_occurred_at, p.event_id as attributed_event_id, p.event_occurred_at as attributed_event_occurred_at, b.x as {column}, 'last_{column}' as attribution_model_name, {sid('attr_res', repr('last_' + column), 'p.touchpoint_batch_id', 'p.event_id', 'p.entity_id')} as attribution_model_result_id
from paths p join (select touchpoint_batch_id, entity_id, entity_type, last_value({value} ignore nulls) over (partition by entity_id, entity_type order by occurred_at, touchpoint_id rows between unbounded preceding and current row) as x from batches) b using (touchpoint_batch_id, entity_id, entity_type) where b.x is not null"""


def _hops(ids: str, entity: str, k: int, name: str) -> None:
    """Adds the mapping CTE ``name``: k rounds of least labels over shared edge_ids."""
    nodes = f"select identifier_type || chr(1) || identifier_value as node, identifier_type, identifier_value, edge_id, event_id, _ingested_at from {ids} where entity_type = '{entity}' and identifier_value is not null and identifier_type is not null"
    C[f"{name}_n"] = nodes
    C[f"{name}_l0"] = f"select distinct node, node as label from {name}_n"
    for i in range(1, k + 1):
        C[f"{name}_e{i}"] = f"select n.edge_id, min(l.label) as label from (select distinct node, edge_id from {name}_n where edge_id is not null) n join {name}_l{i - 1} l on l.node = n.node group by 1"
        C[f"{name}_l{i}"] = f"select l.node, least(min(l.label), coalesce(min(e.label), min(l.label))) as label from {name}_l{i - 1} l left join (select distinct node, edge_id from {name}_n) n on n.node = l.node left join {name}_e{i} e on e.edge_id = n.edge_id group by 1"
    C[f"{name}_f"] = f"select node, identifier_type, identifier_value, event_id from (select *, row_number() over (partition by node order by edge_id nulls first, event_id nulls first) as rn from {name}_n) where rn = 1"
    own = sid("per" if entity == "person" else "grp", "split_part(label, chr(1), 1)", "split_part(label, chr(1), 2)")
    C[name] = f"select {sid(('per' if entity == 'person' else 'grp') + '_idfr', own, 'identifier_type', 'identifier_value')} as identifier_id, {own} as entity_id, event_id, identifier_type, identifier_value, false as realtime_processed, true as existing, 'full_resolution' as resolution_reason, cast(null as varchar) as previous_entity_id, (select max(_ingested_at) from {name}_n) as resolved_at_watermark from {name}_f f join {name}_l{k} l on l.node = f.node"


_hops("web_ids", "person", 2, "web2")
_hops("web_ids", "person", 5, "web5")
_hops("cust_ids", "person", 5, "cper")
_hops("cust_ids", "group", 5, "cgrp")
_hops("segment_entity_identifiers", "person", 5, "sper")
C |= {
    "lookup": "select 'person' as entity_type, identifier_type, identifier_value, entity_id from cper union all select 'group', identifier_type, identifier_value, entity_id from cgrp",
    "rtraits": f"select {sid('ent_tr', 'entity_id', 'trait_name', 'trait_value')} as entity_trait_id, entity_id, entity_type, trait_name, trait_value, occurred_at, false as realtime_processed from (select l.entity_id, t.*, row_number() over (partition by l.entity_id, t.entity_type, trait_name order by occurred_at desc nulls last, trait_value desc) as rn from cust_traits t join lookup l using (entity_type, identifier_type, identifier_value)) where rn = 1",
    "parts": f"select {sid('ent', 'event_id', 'entity_id', 'role')} as entity_participant_id, * from (select distinct i.entity_type, event_id, entity_id, role, occurred_at from cust_ids i join lookup l using (entity_type, identifier_type, identifier_value))",
    "rdecl": "select d.*, a.entity_id as entity_a_id, b.entity_id as entity_b_id from decl d join lookup a on a.entity_type = entity_a_type and a.identifier_type = entity_a_identifier_type and a.identifier_value = entity_a_identifier join lookup b on b.entity_type = entity_b_type and b.identifier_type = entity_b_identifier_type and b.identifier_value = entity_b_identifier",
    "rels": f"select {sid('rel', 'entity_a_id', 'entity_b_id', 'relationship_type')} as relationship_id, entity_a_id, entity_b_id, relationship_type, entity_a_type, entity_a_role, entity_b_type, entity_b_role, relationship_direction, is_active, source, occurred_at as established_at, occurred_at as last_updated_at, lo as _created_at, hi as _updated_at from (select *, row_number() over (w order by occurred_at desc nulls last, relationship_declaration_id desc) as rn, min(occurred_at) over w as lo, max(occurred_at) over w as hi from rdecl window w as (partition by entity_a_id, entity_b_id, relationship_type)) where rn = 1",
    "seen": "select i.*, l.entity_id from cust_ids i join lookup l using (entity_type, identifier_type, identifier_value)",
    "wide": """select e.entity_id, e.entity_type, t.name, t.market_segment, c._created_at, m._last_merged_at, x.last_interaction_at, x.first_interaction_at, coalesce(t._at, c._created_at) as _updated_at
from (select distinct entity_id, entity_type from lookup) e
left join (select entity_id, max(case when trait_name = 'name' then trait_value end) as name, max(case when trait_name = 'Market Segment' then trait_value end) as market_segment, max(occurred_at) as _at from rtraits group by 1) t on t.entity_id = e.entity_id
left join (select entity_id, min(occurred_at) as _created_at from seen group by 1) c on c.entity_id = e.entity_id
left join (select entity_id, max(v.occurred_at) as _last_merged_at from seen s join all_ev v on v.event_id = s.event_id group by 1) m on m.entity_id = e.entity_id
left join (select entity_id, max(v.occurred_at) as last_interaction_at, min(v.occurred_at) as first_interaction_at from parts p join all_ev v on v.event_id = p.event_id group by 1) x on x.entity_id = e.entity_id""",
    "points": "select distinct entity_id, entity_type, valid_from from (select entity_id, entity_type, state_entered_at as valid_from from ustates union all select entity_id, entity_type, state_exited_at from ustates) where valid_from is not null",
    "held": "select p.entity_id, p.entity_type, p.valid_from, state_name, state_value, state_numeric_value, row_number() over (partition by p.entity_id, p.entity_type, p.valid_from, state_name order by state_entered_at desc, state_id desc) as rn from points p join ustates s on s.entity_id = p.entity_id and s.entity_type = p.entity_type and state_entered_at <= valid_from and (state_exited_at is null or state_exited_at > valid_from) where state_value is not null or state_numeric_value is not null",
    "tline0": "select entity_id, entity_type, valid_from, max(case when state_name = 'web_activity' then state_value end) as web_activity, max(case when state_name = 'web_value' then state_numeric_value end) as web_value from held where rn = 1 group by 1, 2, 3",
    "tline": f"select *, web_value - coalesce(lag(web_value) over w, 0) as web_value_delta, lead(valid_from) over w as valid_to, lag(entity_state_id) over w as previous_entity_state_id, lead(valid_from) over w is null as is_current from (select *, {sid('es', 'entity_id', 'valid_from')} as entity_state_id from tline0) window w as (partition by entity_id order by valid_from, entity_type)",
}


def full(body: str) -> str:
    """The query with the CTEs it uses, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in C:
            if name not in need and re.search(rf"(?<![\w.']){name}\b(?!')", text):
                visit(C[name])
                if name not in need:
                    need.append(name)

    visit(body)
    return ("with " + ",\n".join(f"{n} as materialized ({C[n]})" for n in need) + "\n" if need else "") + body

"""Queries over the identity pipeline: event log, resolution, final tables, states, attribution, metadata, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.config import Config, SourceSpec
from idloom.operators import attribution as at
from idloom.operators import entities as en
from idloom.operators import eventlog as ev
from idloom.operators import graph as gr
from idloom.operators import metadata as md
from idloom.operators import relational as rl
from idloom.operators import serving as sv
from idloom.operators import states as st
from idloom.operators.relational import register_entities, snapshot_diff_events, zscores
from idloom.plans import fixtures as fx
from idloom.plans.sql import C, click_sql, full, sid

QUERIES: dict = {}
SQL: dict[str, str] = {}
CONFIG = Config.of(["person", "group"], sources=(SourceSpec("web"), SourceSpec("orders"), SourceSpec("old", enabled=False)))
INTERNAL = ("user1@shop.test", "user2@shop.test")
STATUS = "case when current_active_status and not coalesce(current_buying_status, false) then 'browsing' when current_buying_status then 'buying' else 'idle' end"


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = full(sql)
        return f

    return add


def _maps(s, d) -> dict[str, DataFrame]:
    return gr.resolve_types(fx.customer_identifiers(s, d), CONFIG)


def _lookup(s, d) -> DataFrame:
    return en.identifier_lookup(_maps(s, d))


def _traits(s, d) -> DataFrame:
    return en.resolved_traits(ev.traits([fx.customer_traits(s, d)]), _lookup(s, d))


def _entities(s, d) -> DataFrame:
    i, m = fx.customer_identifiers(s, d), _maps(s, d)
    l = en.identifier_lookup(m)
    return en.entities(i, m, en.resolved_traits(ev.traits([fx.customer_traits(s, d)]), l), fx.all_events(s, d), en.participants(i, l), trait_names=["name", "Market Segment"])


# Event log
q("event_log", "select * from web_ev union all select * from order_ev")(lambda s, d: ev.events(CONFIG.enabled({"web": fx.web_events(s, d), "orders": fx.order_events(s, d), "old": fx.web_events(s, d)}, "events")))
q("event_log_incremental", "select * from web_ev where _ingested_at > (select min(_ingested_at) from web_ev)")(lambda s, d: ev.events([fx.web_events(s, d)], since=fx.web_events(s, d).agg(F.min("_ingested_at")).first()[0]))
q("identifiers_normalized", "select *, case when identifier_type in ('email', 'domain') then lower(identifier_value) when identifier_type = 'phone' then regexp_replace(identifier_value, '[^0-9]', '', 'g') else identifier_value end as normalized_value from (select * from web_ids union all select * from cust_ids)")(lambda s, d: ev.identifiers([fx.web_identifiers(s, d), fx.customer_identifiers(s, d)]))
q("segment_identifiers_normalized", "select entity_identifier_id, event_id, edge_id, entity_type, identifier_type, identifier_value, role, source, occurred_at, coalesce(_ingested_at, occurred_at) as _ingested_at, case when identifier_type in ('email', 'domain') then lower(identifier_value) when identifier_type = 'phone' then regexp_replace(identifier_value, '[^0-9]', '', 'g') else identifier_value end as normalized_value from segment_entity_identifiers")(lambda s, d: ev.identifiers([fx.read(s, d, "segment_entity_identifiers")]))
q("entity_traits", "select * from cust_traits")(lambda s, d: ev.traits([fx.customer_traits(s, d)]))
q("internal_user_traits", f"select * from cust_traits union all select {sid('ent_tr', 'event_id', 'identifier_value', repr('is_internal_user'))}, event_id, entity_type, identifier_type, identifier_value, 'is_internal_user', 'true', source, occurred_at from web_ids where identifier_type = 'email' and lower(identifier_value) in {INTERNAL}")(lambda s, d: ev.traits([fx.customer_traits(s, d)], fx.web_identifiers(s, d), INTERNAL))
q("relationship_declarations", "select * from decl")(lambda s, d: ev.declarations([fx.declarations(s, d)]))
q("dimensions_unioned", "select * from dims")(lambda s, d: ev.dimensions([fx.dimensions(s, d)]))
q("measurements_unioned", "select * from msrs")(lambda s, d: ev.measurements([fx.measurements(s, d)]))
q("states_union", "select * from ustates")(lambda s, d: ev.states([fx.user_states(s, d)]))
q("computed_traits", "select 'ct_' || md5(entity_id) as computed_trait_id, entity_id, entity_type, 'event_count' as trait_name, cast(count(*) as varchar) as trait_value, 'web' as source, cast(null as timestamp) as computed_at from uparts group by entity_id, entity_type")(
    lambda s, d: ev.computed_traits([fx.user_participants(s, d).groupBy("entity_id", F.upper("entity_type").alias("entity_type")).agg(F.count("*").cast("string").alias("trait_value")).select(F.concat(F.lit("ct_"), F.md5("entity_id")).alias("computed_trait_id"), "*", F.lit("Event_Count").alias("trait_name"), F.lit("Web").alias("source"))])
)

# Resolution
q("identifier_edges", "select * from web_edges")(lambda s, d: gr.identifier_edges(fx.web_identifiers(s, d)))
q("connection_counts", "select entity_type_a as entity_type, identifier_type_a as identifier_type, identifier_value_a as identifier_value, count(distinct identifier_value_b) as connections from noisy_edges group by 1, 2, 3")(lambda s, d: gr.connection_counts(gr.identifier_edges(fx.noisy_identifiers(s, d))))
_NOISE = "select entity_type_a as t, identifier_type_a as i, identifier_value_a as v from noisy_edges group by 1, 2, 3 having count(distinct identifier_value_b) > 20"
_KEPT = f"select e.* from noisy_edges e where not exists (select 1 from ({_NOISE}) n where n.t = entity_type_a and n.i = identifier_type_a and n.v = identifier_value_a) and not exists (select 1 from ({_NOISE}) n where n.t = entity_type_b and n.i = identifier_type_b and n.v = identifier_value_b)"
q("edges_autofiltered", _KEPT)(lambda s, d: gr.autofilter(gr.identifier_edges(fx.noisy_identifiers(s, d)), 50, 20))
q("filtered_orphans", f"with_kept as ({_KEPT})" and f"select distinct entity_type, identifier_type, identifier_value from noisy_ids i where not exists (select 1 from ({_KEPT}) k where k.entity_type_a = i.entity_type and k.identifier_type_a = i.identifier_type and k.identifier_value_a = i.identifier_value) and edge_id in (select j.edge_id from noisy_ids j join ({_KEPT}) k on k.entity_type_a = j.entity_type and k.identifier_type_a = j.identifier_type and k.identifier_value_a = j.identifier_value)")(
    lambda s, d: gr.filtered_orphans(fx.noisy_identifiers(s, d), gr.autofilter(gr.identifier_edges(fx.noisy_identifiers(s, d)), 50, 20))
)
q("identifier_edge_members", "select edge_id, entity_type, identifier_type, identifier_value, count(*) over (partition by edge_id) - 1 as links from (select distinct edge_id, entity_type, identifier_type, identifier_value from web_ids where edge_id is not null and identifier_value is not null)")(lambda s, d: gr.edge_members(fx.web_identifiers(s, d)))
_ENDS = lambda s: f"entity_type_{s}, identifier_type_{s}, identifier_value_{s}"
q("edges_with_counts", "select *, " + ", ".join(f"(select count(distinct identifier_value_{o}) from noisy_edges x where x.entity_type_{s} = e.entity_type_{s} and x.identifier_type_{s} = e.identifier_type_{s} and x.identifier_value_{s} = e.identifier_value_{s}{extra}) as connections_{s}_{n}" for s, o in (("a", "b"), ("b", "a")) for extra, n in (("", "total"), (" and x.source = e.source", "per_source"))) + " from noisy_edges e")(lambda s, d: gr.edges_with_counts(gr.identifier_edges(fx.noisy_identifiers(s, d))))
q("edges_new", "select * from web_edges where edge_uniqueness_hash not in (select edge_uniqueness_hash from web_edges where identifier_type_a = 'email' or identifier_type_b = 'email')")(lambda s, d: gr.new_edges(e := gr.identifier_edges(fx.web_identifiers(s, d)), e.where("identifier_type_a = 'email' or identifier_type_b = 'email'")))
for _k in (2, 5):
    q(f"resolved_persons_k{_k}", f"select * from web{_k}")(lambda s, d, k=_k: gr.resolve(fx.web_identifiers(s, d), "person", k))
q("resolved_groups", "select * from cgrp")(lambda s, d: gr.resolve(fx.customer_identifiers(s, d), "group"))
q("resolved_segment_persons", "select * from sper")(lambda s, d: gr.resolve(fx.read(s, d, "segment_entity_identifiers"), "person", 5))
q("events_per_person", "select entity_id, count(distinct i.event_id) as events from web5 m join web_ids i using (identifier_type, identifier_value) group by 1")(
    lambda s, d: gr.resolve(fx.web_identifiers(s, d), "person").select("entity_id", "identifier_type", "identifier_value").join(fx.web_identifiers(s, d), ["identifier_type", "identifier_value"]).groupBy("entity_id").agg(F.count_distinct("event_id").alias("events"))
)

# Final tables
q("identifier_lookup", "select * from lookup")(_lookup)
q("resolved_traits", "select * from rtraits")(_traits)
q("entity_participants", "select * from parts")(lambda s, d: en.participants(fx.customer_identifiers(s, d), _lookup(s, d)))
q("entities_wide", "select * from wide")(_entities)
q("resolved_relationships", "select * from rdecl")(lambda s, d: en.resolved_declarations(fx.declarations(s, d), _lookup(s, d)))
q("relationships", "select * from rels")(lambda s, d: en.relationships(en.resolved_declarations(fx.declarations(s, d), _lookup(s, d))))
_REG = f"select {sid('ent', 's_suppkey', repr('supplier'))} as entity_id, 'supplier' as entity_type, 'supplier' as source, cast(s_suppkey as varchar) as source_id, s_name, cast(null as timestamp) as created_at, cast(null as timestamp) as updated_at from supplier"
q("registered_entities", _REG)(lambda s, d: register_entities(fx.read(s, d, "supplier"), "supplier", "supplier", "s_suppkey", ["s_name"]))
q("non_er_participants", f"select {sid('ent', 'event_id', 'entity_id', 'role')} as entity_participant_id, * from (select distinct 'supplier' as entity_type, {sid('evt', repr('order'), 'l_orderkey')} as event_id, r.entity_id, 'seller' as role, cast(l_shipdate as timestamp) as occurred_at from lineitem join ({_REG}) r on r.source_id = cast(l_suppkey as varchar))")(
    lambda s, d: en.participants(fx.read(s, d, "lineitem").select(F.lit("supplier").alias("entity_type"), fx.make_id("event", F.lit("order"), "l_orderkey").alias("event_id"), F.lit("source_id").alias("identifier_type"), F.col("l_suppkey").cast("string").alias("identifier_value"), F.lit("seller").alias("role"), F.col("l_shipdate").alias("occurred_at")), en.identifier_lookup({}, {"supplier": register_entities(fx.read(s, d, "supplier"), "supplier", "supplier", "s_suppkey")}))
)
q("event_dimensions", "select event_id, occurred_at, source, coalesce(cast(max(case when dimension_name = 'is_urgent' then dimension_value end) as boolean), false) as is_urgent, max(case when dimension_name = 'priority' then dimension_value end) as priority from dims group by 1, 2, 3")(lambda s, d: en.event_dimensions(ev.dimensions([fx.dimensions(s, d)])))
q("event_measurements", "select event_id, occurred_at, source, max(case when measurement_name = 'quantity' then value end) as quantity, max(case when measurement_name = 'revenue' then value end) as revenue from msrs group by 1, 2, 3")(lambda s, d: en.event_measurements(ev.measurements([fx.measurements(s, d)])))
q("scopes", f"select {sid('scp', repr('nation'), 'viewer_id', 'relationship_type', 'resource_id', 'role')} as scope_id, 'nation' as scope_name, *, revoked_at is null as is_active, coalesce(revoked_at, granted_at) as _updated_at from (select entity_a_id as viewer_id, relationship_type, entity_b_id as resource_id, entity_a_role as role, _created_at as granted_at, case when not is_active then last_updated_at end as revoked_at from rels)")(
    lambda s, d: en.scope(QUERIES["relationships"](s, d).select(F.col("entity_a_id").alias("viewer_id"), "relationship_type", F.col("entity_b_id").alias("resource_id"), F.col("entity_a_role").alias("role"), F.col("_created_at").alias("granted_at"), F.when(~F.col("is_active"), F.col("last_updated_at")).alias("revoked_at")), "nation")
)
q("auth_identities", f"select {sid('auth', repr('email'), 'lower(name)')} as auth_identity_id, entity_id, 'email' as provider, lower(name) as provider_subject from wide where entity_type = 'person' and trim(name) <> ''")(lambda s, d: en.auth_identities(_entities(s, d), "name"))
q("identify_export", 'select entity_id as "userId", cast(null as varchar) as "anonymousId", _updated_at as "timestamp", market_segment as segment, name, _created_at as created_at from (select *, row_number() over (partition by lower(trim(name)) order by _updated_at desc nulls last, entity_id desc) as rn from wide where entity_type = \'person\' and market_segment is not null) where rn = 1')(
    lambda s, d: md.identify_export(_entities(s, d).withColumn("uid", F.col("entity_id")), user_id="uid", dedupe_on="name", ignore=["_last_merged_at", "last_interaction_at", "first_interaction_at"], rename={"market_segment": "segment"}, filters=["market_segment is not null"])
)

# States and snapshots
_TLINE = lambda s, d: st.entity_states(ev.states([fx.user_states(s, d)]), ["web_activity"], ["web_value"])
q("entity_states", "select * from tline")(_TLINE)
q("event_state_participants", "select event_id, entity_id, entity_type, occurred_at, entity_state_id from (select u.event_id, u.entity_id, u.entity_type, u.occurred_at, t.entity_state_id, row_number() over (partition by u.event_id, u.entity_id order by t.valid_from desc) as rn from (select distinct event_id, entity_id, entity_type, occurred_at from uparts) u join tline t on t.entity_id = u.entity_id and t.entity_type = u.entity_type and t.valid_from < u.occurred_at and (t.valid_to is null or t.valid_to >= u.occurred_at)) where rn = 1")(
    lambda s, d: st.event_states(fx.user_participants(s, d), _TLINE(s, d))
)
q("derived_state", f"""select entity_id, 'person' as entity_type, 'shop_mode' as state_name, v as state_value, t as state_entered_at, lead(t) over (partition by entity_id order by t, k, trigger_event_id) as state_exited_at, lead(t) over (partition by entity_id order by t, k, trigger_event_id) is null as is_current, trigger_event_id from (
 select *, lag(v) over (partition by entity_id order by t, k, trigger_event_id) as p from (select *, {STATUS} as v from (
  select *, last_value(a ignore nulls) over w as current_active_status, last_value(b ignore nulls) over w as current_buying_status from (
   select entity_id, state_entered_at as t, 0 as k, trigger_event_id, state_value in ('view', 'click') as a, cast(null as boolean) as b from ustates where state_name = 'web_activity' union all
   select entity_id, state_entered_at, 1, trigger_event_id, null, state_numeric_value > 50 from ustates where state_name = 'web_value')
  window w as (partition by entity_id order by t, k, trigger_event_id rows between unbounded preceding and current row)))) where p is null or v <> p""")(
    lambda s, d: st.derived_state("shop_mode", [("active", (u := ev.states([fx.user_states(s, d)])).where("state_name = 'web_activity'"), "state_value in ('view', 'click')"), ("buying", u.where("state_name = 'web_value'"), "state_numeric_value > 50")], STATUS, "person")
)
_SNAP = "select cast(user_id as varchar) as entity_key, event_type as value, ts as seen_at from raw_ev"
q("snapshot_distinct_value", f"select {sid('evt', 'entity_key', 'value', repr('type seen'))} as event_id, entity_key, value, 'type seen' as event_name, 'web' as event_type, 'events' as source, min(seen_at) as occurred_at, min(seen_at) as _ingested_at from ({_SNAP}) group by entity_key, value")(
    lambda s, d: snapshot_diff_events(fx.read(s, d, "events"), "user_id", "event_type", "type seen", "web", "events", "ts", mode="observed")
)
q("snapshot_change", f"select {sid('evt', 'entity_key', 'value', 'run', repr('type changed'))} as event_id, entity_key, value, 'type changed' as event_name, 'web' as event_type, 'events' as source, seen_at as occurred_at, seen_at as _ingested_at from (select *, sum(st) over (partition by entity_key order by seen_at, value rows unbounded preceding) as run from (select *, case when lag(value) over (partition by entity_key order by seen_at, value) = value then 0 else 1 end as st from ({_SNAP}))) where st = 1")(
    lambda s, d: snapshot_diff_events(fx.read(s, d, "events"), "user_id", "event_type", "type changed", "web", "events", "ts", mode="observed", grain="change")
)

# Attribution
_PATHS = lambda s, d: at.touchpoint_paths(fx.touchpoints(s, d), fx.user_participants(s, d))
_BATCHES = lambda s, d: at.path_batches(_PATHS(s, d), fx.touchpoints(s, d))
q("touchpoints", "select * from touch")(lambda s, d: at.union_touchpoints([fx.touchpoints(s, d)], s))
q("touchpoints_none", "select * from (select " + ", ".join(f"cast(null as {'timestamp' if t == 'timestamp_ntz' else 'varchar'}) as {c}" for c, t in at.TOUCHPOINT.items()) + ") where false")(lambda s, d: at.union_touchpoints([], s))
_STUB = lambda schema: "select * from (select " + ", ".join(f"cast(null as {dict(string='varchar', timestamp_ntz='timestamp').get(c.split()[1], c.split()[1])}) as {c.split()[0]}" for c in schema.split(", ")) + ") where false"
q("scopes_none", _STUB(en.SCOPE))(lambda s, d: en.union_scopes([], s))
q("anomalies_none", _STUB(md.ANOMALY))(lambda s, d: md.union_anomalies([], s))
q("touchpoint_paths", "select * from paths")(_PATHS)
q("touchpoint_batches", "select * from batches")(_BATCHES)
q("first_touch", "select * from first_t")(lambda s, d: at.first_touch(_BATCHES(s, d), fx.user_participants(s, d)))
q("last_touch", "select * from last_t")(lambda s, d: at.last_touch(_BATCHES(s, d), fx.user_participants(s, d)))
_RDT = "coalesce(nullif(regexp_extract(landing_url, '[?&]rdt_cid=([^&#]+)', 1), ''), nullif(regexp_extract(landing_url, '[?&]rdclid=([^&#]+)', 1), ''))"
for _c in ("fbclid", "gclid", "ttclid", "li_fat_id", "rdt_cid"):
    C[f"lc_{_c}"] = click_sql(_c, _RDT if _c == "rdt_cid" else f"nullif({_c}, '')")
    q(f"last_click_{_c}", f"select * from lc_{_c}")(lambda s, d, c=_c: at.last_click_id(_BATCHES(s, d), _PATHS(s, d), c, F.expr(_RDT) if c == "rdt_cid" else None))
q("attribution_union", "select * from first_t union all by name select * from last_t union all by name select * from lc_gclid")(lambda s, d: at.union_results([QUERIES[n](s, d) for n in ("first_touch", "last_touch", "last_click_gclid")]))
q("channel_grouping", "select *, 'by_channel' as channel_grouping, channel as channel_value from last_t union all select *, 'by_source', upper(source) from last_t")(lambda s, d: at.channel_groupings(QUERIES["last_touch"](s, d), {"by_channel": "channel", "by_source": "upper(source)"}))

# Metadata and monitoring
q("meta_events", "select event_name, event_type, source, source_table, min(occurred_at) as first_seen_at, max(occurred_at) as last_seen_at, count(*) as event_count from all_ev group by 1, 2, 3, 4")(lambda s, d: md.events_metadata(fx.all_events(s, d)))
q("meta_dimensions", """select s.dimension_name, row_count, distinct_values, example_1, example_2, example_3, array_to_string(list_transform(string_split(s.dimension_name, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') as label from
 (select dimension_name, count(*) as row_count, count(distinct dimension_value) as distinct_values from dims group by 1) s left join
 (select dimension_name, max(case when k = 1 then dimension_value end) as example_1, max(case when k = 2 then dimension_value end) as example_2, max(case when k = 3 then dimension_value end) as example_3 from
  (select dimension_name, dimension_value, row_number() over (partition by dimension_name order by count(*) desc, dimension_value) as k from dims where dimension_value is not null group by 1, 2) group by 1) t using (dimension_name)""")(lambda s, d: md.dimensions_metadata(ev.dimensions([fx.dimensions(s, d)])))
q("meta_measurements", "select measurement_name, value_unit, source, min(value) as min_value, max(value) as max_value, round(avg(value), 4) as avg_value, count(value) as value_count from msrs group by 1, 2, 3")(lambda s, d: md.measurements_metadata(ev.measurements([fx.measurements(s, d)])).withColumn("avg_value", F.round("avg_value", 4)))
q("meta_traits", "select distinct entity_type, trait_name from cust_traits")(lambda s, d: md.traits_metadata(fx.customer_traits(s, d)))
q("meta_identifiers", "select distinct entity_type, identifier_type from segment_entity_identifiers")(lambda s, d: md.identifiers_metadata(fx.read(s, d, "segment_entity_identifiers")))
q("meta_relationships", "select distinct relationship_type, relationship_direction, entity_a_type, entity_b_type from rels")(lambda s, d: md.relationships_metadata(QUERIES["relationships"](s, d)))
q("meta_sources", "select coalesce(c.source, e.source) as source, coalesce(c.enabled, false) as enabled, first_event_at, last_event_at, last_ingested_at, coalesce(event_count, 0) as event_count from (values ('web', true), ('crm', true), ('billing', true)) c(source, enabled) full join (select source, min(occurred_at) as first_event_at, max(occurred_at) as last_event_at, max(_ingested_at) as last_ingested_at, count(*) as event_count from all_ev group by 1) e on e.source = c.source")(
    lambda s, d: md.sources_metadata(s.createDataFrame([("web", True), ("crm", True), ("billing", True)], "source string, enabled boolean"), fx.all_events(s, d))
)
q("meta_states", "select state_name, entity_type, state_category, count(*) as row_count, count(distinct state_value) as distinct_values, coalesce(list_sort(list(distinct state_value) filter (state_value is not null)), []) as possible_values, min(state_numeric_value) as min_value, max(state_numeric_value) as max_value from ustates group by 1, 2, 3")(lambda s, d: md.states_metadata(ev.states([fx.user_states(s, d)])))
q("meta_attribution", "select distinct attribution_model_name, 'campaign' as attribution_field from (select * from first_t union all select * from last_t) where campaign is not null union select distinct attribution_model_name, 'medium' from last_t where medium is not null union select distinct attribution_model_name, 'medium' from first_t where medium is not null")(
    lambda s, d: md.attribution_metadata(at.union_results([QUERIES[n](s, d) for n in ("first_touch", "last_touch")]), ["campaign", "medium"])
)
q("edge_distributions", """select a.*, b.source_distribution, case when connections > 50 then 'CRITICAL' when connections > 20 then 'ERROR' else 'WARNING' end as severity from
 (select entity_type_a, identifier_type_a, identifier_value_a, count(distinct identifier_value_b) as connections, array_to_string(list_sort(list(distinct identifier_type_b)), ', ') as connected_types from noisy_edges group by 1, 2, 3 having count(distinct identifier_value_b) > 10) a join
 (select entity_type_a, identifier_type_a, identifier_value_a, string_agg(src || ' (' || k || ')', ', ' order by k desc, src) as source_distribution from (select entity_type_a, identifier_type_a, identifier_value_a, coalesce(source, 'unknown') as src, count(distinct identifier_value_b) as k from noisy_edges group by 1, 2, 3, 4) group by 1, 2, 3) b using (entity_type_a, identifier_type_a, identifier_value_a)""")(lambda s, d: md.edge_distributions(gr.identifier_edges(fx.noisy_identifiers(s, d))))
_DAY = "select event_type, date_trunc('day', ts) as seen_at, count(*) as n from raw_ev group by 1, 2"
q("anomaly_zscores", f"select {sid('det', repr('daily_events'), 'event_type', 'cast(seen_at as timestamp)')} as detection_id, 'daily_events' as monitor_name, event_type as dimension_key, cast(seen_at as timestamp) as occurred_at, 'day' as granularity, '{{\"event_type\":\"' || event_type || '\"}}' as dimensions, '{{\"n\":' || n || '}}' as measures, round(max_abs_z, 6) as max_abs_z from (select *, abs((n - avg(n) over (partition by event_type)) / nullif(stddev_samp(n) over (partition by event_type), 0)) as max_abs_z from ({_DAY}))")(
    lambda s, d: md.format_anomaly(zscores(fx.read(s, d, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n")), ["event_type"], ["n"]), "daily_events", ["event_type"], ["n"], "at").select("detection_id", "monitor_name", "dimension_key", "occurred_at", "granularity", "dimensions", "measures", F.round("max_abs_z", 6).alias("max_abs_z"))
)


# Serving queries; the parameters are fixed keys of the fixtures.
def _tables(s, d) -> sv.Tables:
    i, m = fx.customer_identifiers(s, d), _maps(s, d)
    l = en.identifier_lookup(m)
    t = ev.traits([fx.customer_traits(s, d)])
    e, p = fx.all_events(s, d), en.participants(i, l)
    ent = en.entities(i, m, en.resolved_traits(t, l), e, p, trait_names=["name", "Market Segment"])
    return sv.Tables(ent, e, p, en.relationships(en.resolved_declarations(fx.declarations(s, d), l)), t, l, gr.identifier_edges(fx.web_identifiers(s, d)))


_ME = "(select entity_id from lookup where identifier_type = 'customer_key' and identifier_value = '7')"


def _me(t: sv.Tables) -> str:
    return t.lookup.where("identifier_type = 'customer_key' and identifier_value = '7'").first().entity_id


q("q_entity_by_identifier", f"select w.*, (select count(*) from rels where entity_a_id = w.entity_id) as membership_count, (select count(*) from rels where entity_b_id = w.entity_id) as person_count from wide w where entity_id = {_ME}")(lambda s, d: sv.entity_by_identifier(_tables(s, d), "7", "person"))
q("q_related_entities", f"select relationship_id, relationship_type, is_active, established_at, entity_b_id as related_entity_id, entity_b_type as related_entity_type from rels where entity_a_id = {_ME}")(lambda s, d: sv.related_entities(t := _tables(s, d), _me(t), "membership", "group"))
q("q_recent_events", f"select * from all_ev where event_id in (select event_id from parts where entity_id = {_ME}) order by occurred_at desc, event_id limit 10")(lambda s, d: sv.recent_events(t := _tables(s, d), _me(t)))
q("q_search_events", "select * from all_ev where lower(event_name) like '%purch%' or lower(event_type) like '%purch%' or lower(source) like '%purch%' order by occurred_at desc, event_id limit 50")(lambda s, d: sv.search_events(_tables(s, d), "purch"))
q("q_event_participants", "select w.*, p.role from wide w join parts p using (entity_id) where p.event_id = (select eid from cust where c_custkey = 7)")(lambda s, d: sv.event_participants(_tables(s, d), fx.customers(s, d).where("c_custkey = 7").first().eid))
q("q_list_entities", "select w.*, coalesce(n, 0) as membership_count from wide w left join (select entity_b_id, count(*) as n from rels group by 1) r on r.entity_b_id = w.entity_id where entity_type = 'group' order by entity_id limit 10 offset 5")(lambda s, d: sv.list_entities(_tables(s, d), "group", limit=10, offset=5))
q("q_memberships", "select * from rels where relationship_type = 'membership' and is_active")(lambda s, d: sv.memberships(_tables(s, d), [{"column": "is_active", "operator": "=", "value": True}]))
q("q_trait_history", f"select t.event_id, t.identifier_type, t.identifier_value, t.trait_name, t.trait_value, t.occurred_at, e.event_name from cust_traits t join lookup l using (entity_type, identifier_type, identifier_value) left join all_ev e on e.event_id = t.event_id where l.entity_id = {_ME} and trait_name = 'Market Segment'")(lambda s, d: sv.trait_history(t := _tables(s, d), _me(t), "Market Segment"))
C["edge_seen"] = "select distinct e.edge_id, e.entity_type_a, e.identifier_type_a, e.identifier_value_a, e.entity_type_b, e.identifier_type_b, e.identifier_value_b, e.source as edge_source, i.event_id, v.event_name, v.event_description, v.source as event_source, v.occurred_at as event_occurred_at from web_edges e left join web_ids i on i.edge_id = e.edge_id and ((i.identifier_type = e.identifier_type_a and i.identifier_value = e.identifier_value_a) or (i.identifier_type = e.identifier_type_b and i.identifier_value = e.identifier_value_b)) left join web_ev v on v.event_id = i.event_id"
_web_tables = lambda s, d, i, l=None: sv.Tables(None, ev.events([fx.web_events(s, d)]), None, None, None, l, gr.identifier_edges(i), i)
q("q_edges_of_entity", "select e.* from edge_seen e where exists (select 1 from web5 l where l.entity_id = (select entity_id from web5 where identifier_type = 'user_id' and identifier_value = '7') and ((l.identifier_type = identifier_type_a and l.identifier_value = identifier_value_a) or (l.identifier_type = identifier_type_b and l.identifier_value = identifier_value_b))) and event_id is not null order by event_occurred_at desc nulls last, edge_id, identifier_value_a, identifier_value_b, event_id limit 200")(
    lambda s, d: sv.edges_of_entity(_web_tables(s, d, i := fx.web_identifiers(s, d), l := en.identifier_lookup({"person": gr.resolve(i, "person")})), l.where("identifier_type = 'user_id' and identifier_value = '7'").first().entity_id, limit=200)
)
q("q_edges_by_identifier", "select * from edge_seen where (identifier_value_a = '7' and identifier_type_a = 'user_id') or (identifier_value_b = '7' and identifier_type_b = 'user_id')")(lambda s, d: sv.edges_by_identifier(_web_tables(s, d, fx.web_identifiers(s, d)), "7", "user_id"))
q("q_search_edges", "select * from web_edges where identifier_type_a = 'email' order by edge_id, edge_uniqueness_hash limit 20 offset 3")(lambda s, d: sv.search_edges(sv.Tables(*[None] * 6, gr.identifier_edges(fx.web_identifiers(s, d))), [{"column": "identifier_type_a", "operator": "=", "value": "email"}], limit=20, offset=3))
q("q_edges_with_issues", "select entity_type_a as entity_type, identifier_type_a as identifier_type, identifier_value_a as identifier_value, count(distinct identifier_value_b) as connections from noisy_edges group by 1, 2, 3 having count(distinct identifier_value_b) > 20 order by 4 desc, 2, 3 limit 500")(lambda s, d: sv.edges_with_issues(sv.Tables(*[None] * 6, gr.identifier_edges(fx.noisy_identifiers(s, d)))))

# Data-quality checks
q("dq_edge_threshold", "select identifier_type_a, count(*) as over from (select identifier_type_a, identifier_value_a from noisy_edges group by 1, 2 having count(distinct identifier_value_b) > 20) group by 1")(lambda s, d: gr.identifier_edges(fx.noisy_identifiers(s, d)).groupBy("identifier_type_a", "identifier_value_a").agg(F.count_distinct("identifier_value_b").alias("n")).where("n > 20").groupBy("identifier_type_a").agg(F.count("*").alias("over")))
q("dq_unit_consistency", "select measurement_name, count(*) as units from (select distinct measurement_name, value_unit from msrs) group by 1")(lambda s, d: ev.measurements([fx.measurements(s, d)]).select("measurement_name", "value_unit").distinct().groupBy("measurement_name").agg(F.count("*").alias("units")))
q("dq_event_keys", "select event_id, count(*) as n from segment_events group by 1 having count(*) > 1")(lambda s, d: rl.key_violations(fx.read(s, d, "segment_events"), ["event_id"]))
q("dq_event_references", "select event_id, count(*) as n from segment_entity_identifiers i where event_id is not null and not exists (select 1 from segment_events e where e.event_id = i.event_id and e.event_type = 'track') group by 1")(lambda s, d: rl.reference_violations(fx.read(s, d, "segment_entity_identifiers"), ["event_id"], fx.read(s, d, "segment_events").where("event_type = 'track'"), ["event_id"]))
_PAIRS = lambda t: f"select distinct l.a, m.identifier_type || ':' || m.identifier_value as b from {t} m join (select entity_id, min(identifier_type || ':' || identifier_value) as a from {t} group by 1) l using (entity_id) where l.a <> m.identifier_type || ':' || m.identifier_value"
q("partition_difference", f"select 'a' as side, * from ({_PAIRS('web2')} except {_PAIRS('web5')}) union all select 'b', * from ({_PAIRS('web5')} except {_PAIRS('web2')})")(
    lambda s, d: rl.differing(*[rl.group_pairs(gr.resolve(fx.web_identifiers(s, d), "person", k).select("entity_id", F.concat_ws(":", "identifier_type", "identifier_value").alias("i")), "entity_id", "i") for k in (2, 5)])
)
q("dq_null_ingested", "select count(*) as missing from gmail_messages where _ingested_at is null")(lambda s, d: fx.read(s, d, "gmail_messages").where("_ingested_at is null").agg(F.count("*").alias("missing")))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL

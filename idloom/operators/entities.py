"""Final tables: resolved traits, participants, relationships, entities, pivots, scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.operators.relational import latest, pivot_eav, union_aligned, union_or_empty

PAIR = ["identifier_type", "identifier_value"]


def identifier_lookup(mappings: dict[str, DataFrame], registered: dict[str, DataFrame] | None = None) -> DataFrame:
    """(entity_type, identifier_type, identifier_value, entity_id) over resolved and registered types."""
    parts = [m.select(F.lit(t).alias("entity_type"), *PAIR, "entity_id") for t, m in mappings.items()]
    parts += [r.select(F.lit(t).alias("entity_type"), F.lit("source_id").alias("identifier_type"), F.col("source_id").alias("identifier_value"), "entity_id") for t, r in (registered or {}).items()]
    return union_aligned(parts)


def resolved_traits(traits: DataFrame, lookup: DataFrame) -> DataFrame:
    """The latest value of each trait of each entity (later time, then greater value)."""
    t = traits.join(lookup, ["entity_type", *PAIR]).select("entity_id", "entity_type", "trait_name", "trait_value", "occurred_at")
    # Nulls sort lowest in max(), as a time unknown is older than any.
    t = latest(t, ["entity_id", "entity_type", "trait_name"], ["occurred_at", "trait_value"])
    return t.select(make_id("entity_trait", "entity_id", "trait_name", "trait_value").alias("entity_trait_id"), "entity_id", "entity_type", "trait_name", "trait_value", "occurred_at", F.lit(False).alias("realtime_processed"))


def participants(identifiers: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row per (event, entity, role, time)."""
    p = identifiers.join(lookup, ["entity_type", *PAIR]).select("entity_type", "event_id", "entity_id", "role", "occurred_at").distinct()
    return p.select(make_id("entity_participant", "event_id", "entity_id", "role").alias("entity_participant_id"), "entity_type", "event_id", "entity_id", "role", "occurred_at")


def with_aliases(lookup: DataFrame, registered: dict[str, DataFrame]) -> DataFrame:
    """The lookup plus, for registered entities, their id under the name of their source (identifier_type ``<source>_id``)."""
    more = [r.select(F.lit(t).alias("entity_type"), F.concat("source", F.lit("_id")).alias("identifier_type"), F.col("source_id").alias("identifier_value"), "entity_id").distinct() for t, r in registered.items()]
    return union_aligned([lookup, *more]).distinct()


def resolved_declarations(decl: DataFrame, lookup: DataFrame) -> DataFrame:
    """Declarations with the entities of both ends; those without both are dropped. ``with_aliases`` adds the names that
    sources give their own entities."""
    for s in ("a", "b"):
        side = lookup.select(F.col("entity_type").alias(f"entity_{s}_type"), F.col("identifier_type").alias(f"entity_{s}_identifier_type"), F.col("identifier_value").alias(f"entity_{s}_identifier"), F.col("entity_id").alias(f"entity_{s}_id"))
        decl = decl.join(side, [f"entity_{s}_type", f"entity_{s}_identifier_type", f"entity_{s}_identifier"])
    return decl


def relationships(resolved: DataFrame) -> DataFrame:
    """The latest declaration of each (a, b, type) with the first and last time it was declared."""
    keys = ["entity_a_id", "entity_b_id", "relationship_type"]
    vals = ["entity_a_type", "entity_a_role", "entity_b_type", "entity_b_role", "relationship_direction", "is_active", "source"]
    g = resolved.groupBy(*keys).agg(F.max(F.struct("occurred_at", "relationship_declaration_id", *vals)).alias("m"), F.min("occurred_at").alias("_created_at"), F.max("occurred_at").alias("_updated_at"))
    return g.select(make_id("relationship", *keys).alias("relationship_id"), *keys, *[F.col(f"m.{v}").alias(v) for v in vals], F.col("m.occurred_at").alias("established_at"), F.col("m.occurred_at").alias("last_updated_at"), "_created_at", "_updated_at")


def entities(identifiers: DataFrame, mappings: dict[str, DataFrame], latest_traits: DataFrame, events: DataFrame, parts: DataFrame, registered: dict[str, DataFrame] | None = None, computed: DataFrame | None = None, trait_names: list[str] | None = None) -> DataFrame:
    """Every entity with its latest traits as columns, its times and first and last interaction.

    A registered type's column fills a trait of the same name; a computed trait never overrides a column.
    """
    lookup = identifier_lookup(mappings)
    base = [m.select("entity_id", F.lit(t).alias("entity_type")).distinct() for t, m in mappings.items()]
    registered = registered or {}
    base += [r.select("entity_id", "entity_type").distinct() for r in registered.values()]
    e = union_aligned(base)
    seen = identifiers.join(lookup, ["entity_type", *PAIR])
    # All times of an entity come from one aggregate: events are joined once, for identifier rows and participants alike.
    kinds = lambda df, kind: df.select("entity_id", "event_id", F.lit(kind).alias("_kind"))
    linked = kinds(seen.where("edge_id is not null"), "merged").unionByName(kinds(parts, "met")).distinct()
    met = linked.join(events.select("event_id", F.col("occurred_at").alias("_at")), "event_id").select("entity_id", "_kind", "_at")
    times = met.unionByName(seen.select("entity_id", F.lit("created").alias("_kind"), F.col("occurred_at").alias("_at"))).unionByName(latest_traits.select("entity_id", F.lit("trait").alias("_kind"), F.col("occurred_at").alias("_at")))
    when = lambda kind: F.when(F.col("_kind") == kind, F.col("_at"))
    times = times.groupBy("entity_id").agg(F.min(when("created")).alias("_created_at"), F.max(when("merged")).alias("_last_merged_at"), F.max(when("trait")).alias("_trait_at"), F.max(when("met")).alias("last_interaction_at"), F.min(when("met")).alias("first_interaction_at"))
    wide = pivot_eav(latest_traits, ["entity_id"], "trait_name", "trait_value", trait_names)
    out = reduce(lambda a, b: a.join(b, "entity_id", "left"), [wide, times], e)
    if registered:
        own = union_aligned([r.drop("entity_type", "created_at", "updated_at") for r in registered.values()])
        own = own.select("entity_id", *[F.col(c).alias("_own_" + c) for c in own.columns if c != "entity_id"])
        out = out.join(own, "entity_id", "left")
        for c in [c[5:] for c in own.columns if c != "entity_id"]:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col("_own_" + c).cast("string")) if c in out.columns else F.col("_own_" + c)).drop("_own_" + c)
    if computed is not None:
        more = pivot_eav(computed, ["entity_id"], "trait_name", "trait_value")
        new = [c for c in more.columns if c == "entity_id" or c not in out.columns]
        out = out.join(more.select(*new), "entity_id", "left")
    return out.withColumn("_updated_at", F.coalesce("_trait_at", "_created_at")).drop("_trait_at")


def event_dimensions(dims: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Wide dimensions per (event, time, source); is_* are booleans, false where missing."""
    keys = ["event_id", "occurred_at", "source"]
    w = pivot_eav(dims, keys, "dimension_name", "dimension_value", names)
    return w.select(*[F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)).alias(c) if c.startswith("is_") and c not in keys else F.col(c) for c in w.columns])


def event_measurements(ms: DataFrame, names: list[str] | None = None) -> DataFrame:
    return pivot_eav(ms, ["event_id", "occurred_at", "source"], "measurement_name", "value", names)


def scope(df: DataFrame, name: str) -> DataFrame:
    """Authorization tuples (viewer_id, relationship_type, resource_id, role, granted_at, revoked_at) as scope rows."""
    return df.select(
        make_id("scope", F.lit(name), "viewer_id", "relationship_type", "resource_id", "role").alias("scope_id"), F.lit(name).alias("scope_name"), "viewer_id", "relationship_type", "resource_id", "role", "granted_at", "revoked_at",
        F.col("revoked_at").isNull().alias("is_active"), F.coalesce("revoked_at", "granted_at").alias("_updated_at"),
    )


#: The contract of scope rows.
SCOPE = "scope_id string, scope_name string, viewer_id string, relationship_type string, resource_id string, role string, granted_at timestamp_ntz, revoked_at timestamp_ntz, is_active boolean, _updated_at timestamp_ntz"


def union_scopes(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """The rows of all scope models; a typed empty table without one."""
    return union_or_empty(parts, spark, SCOPE)


def auth_identities(entities_df: DataFrame, email: str = "email") -> DataFrame:
    """Sign-in identities of persons with an address; none where entities have no such column."""
    if email not in entities_df.columns:
        return entities_df.select(F.lit("").alias("auth_identity_id"), "entity_id", F.lit("email").alias("provider"), F.lit("").alias("provider_subject")).limit(0)
    e = entities_df.where((F.col("entity_type") == "person") & (F.trim(email) != ""))
    return e.select(make_id("auth_identity", F.lit("email"), F.lower(email)).alias("auth_identity_id"), "entity_id", F.lit("email").alias("provider"), F.lower(email).alias("provider_subject"))

"""Parameterised read queries over the finished tables."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.operators.relational import select_where


@dataclass
class Tables:
    entities: DataFrame
    events: DataFrame
    participants: DataFrame
    relationships: DataFrame
    traits: DataFrame
    lookup: DataFrame
    edges: DataFrame
    identifiers: DataFrame | None = None


def envelope(df: DataFrame, query: str) -> dict:
    """Run a bounded query: {data, executedAt, executionTime, rowCount, query}."""
    at = time.time()
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return {"data": rows, "executedAt": at, "executionTime": time.time() - at, "rowCount": len(rows), "query": query}


def entity_by_identifier(t: Tables, identifier: str, entity_type: str | None = None) -> DataFrame:
    """The entity of an entity id, else of a person identifier, else of a group identifier, with its counts."""
    own = t.entities.where(F.col("entity_id") == identifier).select("entity_id", F.lit(0).alias("_p"))
    via = t.lookup.where(F.col("identifier_value") == identifier).select("entity_id", F.when(F.col("entity_type") == "person", 1).otherwise(2).alias("_p"))
    hit = own.unionByName(via).groupBy("entity_id").agg(F.min("_p").alias("_p"))
    e = hit.join(t.entities, "entity_id")
    if entity_type:
        e = e.where(F.col("entity_type") == entity_type)
    e = e.orderBy("_p", "entity_id").limit(1).drop("_p")
    m = t.relationships.where("relationship_type = 'membership'")
    a = m.groupBy(F.col("entity_a_id").alias("entity_id")).agg(F.count("*").alias("membership_count"))
    b = m.groupBy(F.col("entity_b_id").alias("entity_id")).agg(F.count("*").alias("person_count"))
    return e.join(a, "entity_id", "left").join(b, "entity_id", "left").fillna(0, ["membership_count", "person_count"])


def related_entities(t: Tables, entity_id: str, relationship_type: str | None = None, related_type: str | None = None, filters: list[dict] = (), order: list[Column] = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Entities at the other end of an entity's relationships, either way round, without an OR join."""
    r = t.relationships
    keep = ["relationship_id", "relationship_type", "is_active", "established_at"]
    one = lambda me, other, other_type: r.where(F.col(me) == entity_id).select(*keep, F.col(other).alias("related_entity_id"), F.col(other_type).alias("related_entity_type"))
    out = one("entity_a_id", "entity_b_id", "entity_b_type").unionByName(one("entity_b_id", "entity_a_id", "entity_a_type")).distinct()
    if relationship_type:
        out = out.where(F.col("relationship_type") == relationship_type)
    if related_type:
        out = out.where(F.col("related_entity_type") == related_type)
    return select_where(out, filters, order or [F.col("established_at").desc_nulls_last(), F.col("relationship_id")], limit, offset)


def recent_events(t: Tables, entity_id: str, event_type: str | None = None, filters: list[dict] = (), limit: int = 10, order: list[Column] = ()) -> DataFrame:
    e = t.events.join(t.participants.where(F.col("entity_id") == entity_id).select("event_id").distinct(), "event_id", "left_semi")
    if event_type:
        e = e.where(F.col("event_type") == event_type)
    return select_where(e, filters, list(order) or [F.col("occurred_at").desc_nulls_last(), F.col("event_id")], limit)


def search_events(t: Tables, query: str | None = None, filters: list[dict] = (), limit: int = 50, order: list[Column] = ()) -> DataFrame:
    e = t.events
    if query:
        e = e.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(query.lower()) for c in ("event_name", "event_type", "source")]))
    return select_where(e, filters, list(order) or [F.col("occurred_at").desc_nulls_last(), F.col("event_id")], limit)


def event_participants(t: Tables, event_id: str, filters: list[dict] = ()) -> DataFrame:
    p = t.participants.where(F.col("event_id") == event_id).select("entity_id", "role")
    return select_where(t.entities.join(p, "entity_id"), filters)


def list_entities(t: Tables, entity_type: str | None = None, filters: list[dict] = (), order: list[Column] = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
    e = t.entities
    if entity_type:
        e = e.where(F.col("entity_type") == entity_type)
        if not filters:
            side = "a" if entity_type == "person" else "b"
            n = t.relationships.where("relationship_type = 'membership'").groupBy(F.col(f"entity_{side}_id").alias("entity_id")).agg(F.count("*").alias("membership_count"))
            e = e.join(n, "entity_id", "left").fillna(0, ["membership_count"])
    return select_where(e, filters, order or [F.col("entity_id")], limit, offset)


def memberships(t: Tables, filters: list[dict] = (), limit: int | None = None) -> DataFrame:
    return select_where(t.relationships.where("relationship_type = 'membership'"), filters, [F.col("relationship_id")] if limit else (), limit)


def trait_history(t: Tables, entity_id: str, trait: str) -> DataFrame:
    """Every value a trait of an entity ever had, latest first."""
    ids = t.lookup.where(F.col("entity_id") == entity_id)
    h = t.traits.where(F.col("trait_name") == trait).join(ids, ["entity_type", "identifier_type", "identifier_value"])
    h = h.select("event_id", "identifier_type", "identifier_value", "trait_name", "trait_value", "occurred_at")
    return h.join(t.events.select("event_id", "event_name"), "event_id", "left").orderBy(F.col("occurred_at").desc_nulls_last(), "trait_value", "identifier_value")


_EDGE = ["edge_id", "entity_type_a", "identifier_type_a", "identifier_value_a", "entity_type_b", "identifier_type_b", "identifier_value_b"]


def _edge_events(t: Tables, edges: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Each edge with the events of the identifier rows that carry it, at either end: two equi joins and a distinct union."""
    rows = t.identifiers if entity_type is None else t.identifiers.where(F.col("entity_type") == entity_type)
    rows = rows.select("edge_id", "identifier_type", "identifier_value", "event_id").distinct()
    e = edges.select(*_EDGE, F.col("source").alias("edge_source")).distinct()
    sides = [e.join(rows.select("edge_id", F.col("identifier_type").alias(f"identifier_type_{s}"), F.col("identifier_value").alias(f"identifier_value_{s}"), "event_id"), ["edge_id", f"identifier_type_{s}", f"identifier_value_{s}"]).select(*e.columns, "event_id") for s in ("a", "b")]
    return sides[0].unionByName(sides[1]).distinct()


def _with_events(t: Tables, found: DataFrame, order: list[Column], limit: int | None, filters: list[dict] = ()) -> DataFrame:
    ev = t.events.select("event_id", "event_name", "event_description", F.col("source").alias("event_source"), F.col("occurred_at").alias("event_occurred_at"))
    ties = [F.col("edge_id"), F.col("identifier_value_a"), F.col("identifier_value_b"), F.col("event_id")]
    return select_where(found.join(ev, "event_id", "left").select(*found.columns, *ev.columns[1:]), filters, [*(order or [F.col("event_occurred_at").desc_nulls_last()]), *ties], limit)


def edges_of_entity(t: Tables, entity_id: str, entity_type: str | None = None, order: list[Column] = (), limit: int | None = None) -> DataFrame:
    """Edges with an identifier of the entity at either end and the events they were seen in, latest first.

    Both ends of an edge are of one type: ``entity_type``, else person or group; events are those of rows of that type
    (person without one).
    """
    ids = t.lookup.where(F.col("entity_id") == entity_id).select("identifier_type", "identifier_value")
    types = [entity_type] if entity_type else ["person", "group"]
    edges = t.edges.where((F.col("entity_type_a") == F.col("entity_type_b")) & F.col("entity_type_a").isin(*types))
    sides = [edges.join(ids.select(*[F.col(c).alias(f"{c}_{s}") for c in ids.columns]), [f"{c}_{s}" for c in ids.columns], "left_semi") for s in ("a", "b")]
    return _with_events(t, _edge_events(t, sides[0].unionByName(sides[1]).distinct(), entity_type or "person"), list(order), limit)


def edges_by_identifier(t: Tables, value: str, identifier_type: str | None = None, entity_type: str | None = None, filters: list[dict] = (), order: list[Column] = (), limit: int | None = None) -> DataFrame:
    """Edges with the identifier at either end and the events they were seen in, latest first; an edge without events is
    listed once."""
    out = None
    for s in ("a", "b"):
        e = t.edges.where(F.col(f"identifier_value_{s}") == value)
        if identifier_type:
            e = e.where(F.col(f"identifier_type_{s}") == identifier_type)
        if entity_type:
            e = e.where(F.col(f"entity_type_{s}") == entity_type)
        out = e if out is None else out.unionByName(e)
    out = out.distinct()
    seen = _edge_events(t, out)
    bare = out.select(*_EDGE, F.col("source").alias("edge_source")).distinct().join(seen.select(*_EDGE).distinct(), _EDGE, "left_anti")
    return _with_events(t, seen.unionByName(bare.withColumn("event_id", F.lit(None).cast("string")).select(*seen.columns)), list(order), limit, filters)


def search_edges(t: Tables, filters: list[dict] = (), order: list[Column] = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
    return select_where(t.edges, filters, order or [F.col("edge_id"), F.col("edge_uniqueness_hash")], limit, offset)


def edges_with_issues(t: Tables, min_connections: int = 20, limit: int = 500) -> DataFrame:
    """Identifiers with more than so many distinct neighbours."""
    n = t.edges.groupBy(F.col("entity_type_a").alias("entity_type"), F.col("identifier_type_a").alias("identifier_type"), F.col("identifier_value_a").alias("identifier_value")).agg(F.count_distinct("identifier_value_b").alias("connections"))
    return n.where(F.col("connections") > min_connections).orderBy(F.col("connections").desc(), "identifier_type", "identifier_value").limit(limit)

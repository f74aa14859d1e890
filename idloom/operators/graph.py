"""Depth-bounded entity resolution over co-occurring identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.config import Config
from idloom.functions.ids import make_id, surrogate_key
from idloom.operators.skew import join_even, join_label
from idloom.storage import cut

_ENDS = ["entity_type_a", "identifier_type_a", "identifier_value_a", "entity_type_b", "identifier_type_b", "identifier_value_b"]


def identifier_edges(identifiers: DataFrame) -> DataFrame:
    """Every ordered pair of different identifiers that share an edge_id, once, with its earliest edge.

    The pairs are the operator's result. Resolution does not use them (``resolve`` works on the rows themselves), unless
    the noise filter is on. Copies are dropped before the join, so an edge costs its distinct identifiers squared.
    """
    i = identifiers.where("edge_id is not null and identifier_value is not null").select("edge_id", "entity_type", "identifier_type", "identifier_value", "source", "_ingested_at")
    i = i.groupBy("edge_id", "entity_type", "identifier_type", "identifier_value").agg(F.min(F.struct("_ingested_at", "source")).alias("_m")).select("edge_id", "entity_type", "identifier_type", "identifier_value", F.col("_m._ingested_at").alias("_ingested_at"), F.col("_m.source").alias("source"))
    a = i.select("edge_id", *[F.col(c).alias(c + "_a") for c in ("entity_type", "identifier_type", "identifier_value")], "source", "_ingested_at")
    b = i.select("edge_id", *[F.col(c).alias(c + "_b") for c in ("entity_type", "identifier_type", "identifier_value")])
    pairs = a.join(b, "edge_id").where("entity_type_a <> entity_type_b or identifier_type_a <> identifier_type_b or identifier_value_a <> identifier_value_b")
    one = pairs.groupBy(*_ENDS).agg(F.min(F.struct("_ingested_at", "edge_id", "source")).alias("m"))
    return one.select(F.col("m.edge_id").alias("edge_id"), *_ENDS, F.col("m.source").alias("source"), F.col("m._ingested_at").alias("_ingested_at"), surrogate_key(*_ENDS).alias("edge_uniqueness_hash"))


def edge_members(identifiers: DataFrame) -> DataFrame:
    """(edge_id, entity_type, identifier_type, identifier_value, links): the members of each edge and with how many others it
    links them. The linear form of ``identifier_edges``: one row a member instead of all pairs."""
    keys = ["edge_id", "entity_type", "identifier_type", "identifier_value"]
    i = identifiers.where("edge_id is not null and identifier_value is not null").select(*keys).distinct()
    # Sizes are counted map-side and joined back in parts, so an edge with a third of all rows is not gathered.
    sizes = i.groupBy("edge_id").agg(F.count("*").alias("_n"))
    return join_label(i, sizes.withColumn("links", F.col("_n") - 1), "edge_id", "_n", "identifier_value")


def connection_counts(edges: DataFrame) -> DataFrame:
    """(entity_type, identifier_type, identifier_value, connections): distinct neighbour values of each identifier."""
    return edges.groupBy(F.col("entity_type_a").alias("entity_type"), F.col("identifier_type_a").alias("identifier_type"), F.col("identifier_value_a").alias("identifier_value")).agg(F.count_distinct("identifier_value_b").alias("connections"))


def edges_with_counts(edges: DataFrame) -> DataFrame:
    """Edges with the connections of either end, over all sources and within the edge's source.

    Each count is an aggregate joined back, not a window, so the edges of a hub are not gathered.
    """
    out = edges
    for s, o in (("a", "b"), ("b", "a")):
        end = [f"entity_type_{s}", f"identifier_type_{s}", f"identifier_value_{s}"]
        for keys, name in ((end, f"connections_{s}_total"), (["source", *end], f"connections_{s}_per_source")):
            n = edges.groupBy(*keys).agg(F.count_distinct(f"identifier_value_{o}").alias(name))
            for k in keys:
                n = n.withColumnRenamed(k, "_" + k)
            cond = reduce(lambda x, y: x & y, [out[k].eqNullSafe(n["_" + k]) for k in keys])
            out = out.join(n, cond, "left").drop(*["_" + k for k in keys])
    return out


def autofilter(edges: DataFrame, critical: int | None = None, error: int | None = None, incremental: bool = False) -> DataFrame:
    """Edges none of whose ends has more connections than the thresholds given.

    Filtering takes back edges as counts grow, which can split entities; incremental resolution can't follow that, so the
    two together are refused.
    """
    limits = [x for x in (critical, error) if x is not None]
    if limits and incremental:
        raise ValueError("edge filters and incremental resolution exclude each other: turn off one of them")
    if not limits:
        return edges
    noisy = connection_counts(edges).where(F.col("connections") > min(limits)).select("entity_type", "identifier_type", "identifier_value")
    out = edges
    for s in ("a", "b"):
        out = out.join(noisy.select(*[F.col(c).alias(f"{c}_{s}") for c in noisy.columns]), [f"{c}_{s}" for c in noisy.columns], "left_anti")
    return out


def new_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose hash is not among the known ones."""
    return edges.join(known.select("edge_uniqueness_hash"), "edge_uniqueness_hash", "left_anti").select(*edges.columns)


def filtered_orphans(identifiers: DataFrame, edges: DataFrame) -> DataFrame:
    """Identifiers without a surviving edge that share an edge_id with one that has a surviving edge."""
    cols = ["entity_type", "identifier_type", "identifier_value"]
    linked = edges.select(*[F.col(c + "_a").alias(c) for c in cols]).distinct()
    i = identifiers.where("edge_id is not null").select("edge_id", *cols).distinct()
    touched = i.join(linked, cols, "left_semi").select("edge_id").distinct()
    return i.join(linked, cols, "left_anti").join(touched, "edge_id", "left_semi").select(*cols).distinct()


def propagate(nodes: DataFrame, links: DataFrame, rounds: int | None) -> DataFrame:
    """(node, label): the least label within ``rounds`` hops (None: to the fixpoint), where one hop leads from a node over
    a link to every node of that link. links: (node, link). A round is linear in the rows of ``links``; both minima
    are combined map-side, and the rows of a link or node with many of them are joined in parts. Rounds are cut into
    written tables and end early when no label changes, which can't change the result. Every node of ``links`` must be
    one of ``nodes``."""
    table = cut(nodes.select("node", F.col("node").alias("label")))
    written = cut(links)
    l = written.df
    most = l.count()
    done = 0
    while rounds is None or done < rounds:
        done += 1
        cur = table.df
        heard = join_even(l, cur, "node", "link", at_most=most).groupBy("link").agg(F.min("label").alias("label"))
        best = join_even(l, heard, "link", "node", at_most=most).groupBy("node").agg(F.min("label").alias("_new"))
        nxt = cut(cur.join(best, "node", "left").select("node", F.least("label", F.coalesce("_new", "label")).alias("label"), (F.col("_new") < F.col("label")).alias("_moved")))
        table.drop()
        moved = not nxt.df.where("_moved").isEmpty()
        table = nxt
        table.df = nxt.df.select("node", "label")
        if not moved:
            break
    written.drop()
    return table.df


def _node(t: str, v: str):
    # Type and value in one text that sorts like the pair.
    return F.concat(F.col(t), F.lit("\x01"), F.col(v))


def resolve(identifiers: DataFrame, entity_type: str, max_recursion: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """The mapping of each identifier of a type to its entity.

    The entity is named by the least (identifier_type, identifier_value) within ``max_recursion`` hops over shared edge_ids.
    ``edges`` (e.g. filtered ones) replaces them by the given pairs and leaves out identifiers that the filter orphaned.
    Identifiers of other types, null values and null edge_ids link nothing.
    """
    i = identifiers.where((F.col("entity_type") == entity_type) & F.col("identifier_value").isNotNull() & F.col("identifier_type").isNotNull())
    if edges is not None:
        lost = filtered_orphans(identifiers, edges)
        i = i.join(lost, ["entity_type", "identifier_type", "identifier_value"], "left_anti")
        e = edges.where((F.col("entity_type_a") == entity_type) & (F.col("entity_type_b") == entity_type))
        links = e.select(_node("identifier_type_a", "identifier_value_a").alias("node"), F.col("edge_uniqueness_hash").alias("link")).unionByName(e.select(_node("identifier_type_b", "identifier_value_b").alias("node"), F.col("edge_uniqueness_hash").alias("link")))
    else:
        links = i.where("edge_id is not null").select(_node("identifier_type", "identifier_value").alias("node"), F.col("edge_id").alias("link")).distinct()
    first = i.groupBy("identifier_type", "identifier_value").agg(F.min(F.struct("edge_id", "event_id")).alias("m"))
    nodes = first.select(_node("identifier_type", "identifier_value").alias("node"), "identifier_type", "identifier_value", F.col("m.event_id").alias("event_id"))
    labels = propagate(nodes, links, max_recursion)
    mark = F.lit(i.agg(F.max("_ingested_at")).first()[0]).cast("timestamp_ntz").alias("resolved_at_watermark")
    m = nodes.join(labels, "node")
    t, v = F.split_part("label", F.lit("\x01"), F.lit(1)), F.split_part("label", F.lit("\x01"), F.lit(2))
    return m.select(
        make_id(f"{entity_type}_identifier", make_id(entity_type, t, v), "identifier_type", "identifier_value").alias("identifier_id"), make_id(entity_type, t, v).alias("entity_id"), "event_id", "identifier_type", "identifier_value",
        F.lit(False).alias("realtime_processed"), F.lit(True).alias("existing"), F.lit("full_resolution").alias("resolution_reason"), F.lit(None).cast("string").alias("previous_entity_id"), mark,
    )


def resolve_types(identifiers: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The mapping of every resolved entity type, with the configured depth and edge filters."""
    on = config.thresholds()
    edges = autofilter(identifier_edges(identifiers), **on, incremental=config.incremental) if any(v is not None for v in on.values()) else None
    return {t: resolve(identifiers, t, config.max_recursion, edges) for t in config.resolved_types()}

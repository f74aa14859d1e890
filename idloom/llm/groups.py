"""Consolidating pairwise matches into groups by deterministic Borůvka hooking.

Each round every component selects its smallest outgoing edge, the trees this makes collapse by pointer doubling, and
the edges are relabelled and deduplicated, until none remain. A round at least halves the components that still have
edges, so the rounds grow with the logarithm of the records, whatever the shape of the chains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.text import norm_text
from idloom.operators.skew import join_even, join_label
from idloom.storage import Table, cut


def node_id(*parts: Column) -> Column:
    """A 128-bit node identifier of a tuple of texts; lengths keep ('a', 'bc') and ('ab', 'c') apart."""
    return F.unhex(F.md5(F.concat_ws("|", *[F.concat(F.length(p), F.lit(":"), p) for p in parts])))


def star_edges(members: DataFrame, link: str, node: str) -> DataFrame:
    """(u, v): each node with the node that stands for its link. Linear in the rows: no pairs within a link."""
    return members.select(F.col(node).alias("u"), F.col(link).alias("v"))


def _union(tables: list[Table]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.df for t in tables])


def _collapse(hooks: Table, nodes: int) -> list[Table]:
    """Pointer doubling: (node, parent, settled) tables in which every node's parent is the root of its tree.

    hooks: (node, parent, settled) of at most ``nodes`` nodes, where roots are their own settled parents. A node settles once its parent is known to
    be a root; settled nodes are written once and only looked up afterwards, the active ones jump to their parent's
    parent. A parent with many active children is looked up in parts.
    """
    done = [Table(hooks.df.where("settled"), hooks.path)]
    active = Table(hooks.df.where("not settled"), hooks.path)
    while not active.df.isEmpty():
        up = active.df.select(F.col("parent").alias("_at"), "node")
        at = _union([*done, active]).select(F.col("node").alias("_at"), F.col("parent").alias("_next"), F.col("settled").alias("_settled"))
        step = join_even(up, at, "_at", "node", at_most=nodes)
        out = cut(step.select("node", F.col("_next").alias("parent"), F.col("_settled").alias("settled")))
        done.append(Table(out.df.where("settled"), out.path))
        active = Table(out.df.where("not settled"), out.path)
    return done


def _relabel(edges: DataFrame, parent: DataFrame, n: int) -> DataFrame:
    """Edges between components: both ends replaced by their roots, loops dropped, duplicates merged map-side. The many
    edges of a hub are joined in parts."""
    e = edges
    for end, other in (("u", "v"), ("v", "u")):
        at = parent.select(F.col("node").alias(end), F.col("parent").alias("_p"))
        e = join_even(e, at, end, other, at_most=n).select(F.coalesce("_p", end).alias(end), other)
    return e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> tuple[list[Table], int]:
    """``boruvka`` with its result as tables that the caller drops."""
    clean = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    current = cut(clean)
    labels: list[Table] = []
    rounds = 0
    # Nodes are at most twice the edges, so these counts bound the rows of every join.
    n = current.df.count()
    most = 2 * n
    while n:
        rounds += 1
        e = current.df
        ends = e.select(F.col("u").alias("node"), F.struct("u", "v").alias("e")).unionByName(e.select(F.col("v").alias("node"), F.struct("u", "v").alias("e")))
        # The smallest outgoing edge of each component: one partial row per component and task, so hubs are no hot keys.
        best = ends.groupBy("node").agg(F.min("e").alias("e")).select("node", F.when(F.col("node") == F.col("e.u"), F.col("e.v")).otherwise(F.col("e.u")).alias("parent"), "e")
        picks = cut(best)
        # A pair that chose the same edge from both ends: its smaller end becomes the root.
        b = picks.df
        chosen = b.groupBy("e").agg(F.count("*").alias("_n")).where("_n = 2").select(F.col("e.u").alias("node"), F.lit(True).alias("_root"))
        root = F.coalesce("_root", F.lit(False))
        hooks = cut(b.join(chosen, "node", "left").select("node", F.when(root, F.col("node")).otherwise(F.col("parent")).alias("parent"), root.alias("settled")))
        picks.drop()
        parts = _collapse(hooks, 2 * n)
        parent = _union(parts)
        nxt = cut(_relabel(e, parent, n))
        current.drop()
        current = nxt
        n = current.df.count()
        if not labels:
            labels = parts
            continue
        # Labels of the rounds before move on to the new roots; those of a hot root in parts.
        old = _union(labels).select("node", "parent")
        at = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_p"))
        merged = cut(join_even(old, at, "parent", "node", at_most=most).select("node", F.coalesce("_p", "parent").alias("parent")))
        for t in (*labels, *parts):
            t.drop()
        labels = [merged]
    current.drop()
    return labels, rounds


def boruvka(edges: DataFrame) -> tuple[DataFrame, int]:
    """((node, root) of every node with an edge, rounds) for undirected edges (u, v) of comparable ids.

    Edges are ordered by (least, greatest) of their ends' labels, the same from either end, so the selected edges form
    trees but for pairs that chose each other; of such a pair the smaller label is the root. Loops and repeated edges,
    also reversed ones, change nothing; edges with a null end are left out; no edges give no rows. Each round's tables are
    written to the shared folder and those of the round before deleted.
    """
    labels, rounds = components(edges)
    if not labels:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0), rounds
    return _union([Table(t.df.select("node", F.col("parent").alias("root")), t.path) for t in labels]), rounds


def group_identifiers(df: DataFrame, entity_type: str, link: str, id_type: str, id_value: str) -> DataFrame:
    """(entity_type, identifier_type, identifier_value, group_key): one row per distinct identifier.

    Identifiers are (entity type, identifier type, trimmed lower-case value); rows with a null-like value or a null
    entity or identifier type give none. Those of one entity type that share a non-null link are one group, directly or
    through others. group_key is the least ``type:value`` of the group by code point; an identifier without links is its
    own group. Links are nodes of their own, so a link with n identifiers costs n edges.
    """
    rows = df.select(F.col(entity_type).alias("entity_type"), F.col(id_type).alias("identifier_type"), norm_text(F.col(id_value)).alias("identifier_value"), F.col(link).alias("link"))
    rows = rows.where("entity_type is not null and identifier_type is not null and identifier_value is not null").distinct()
    written = cut(rows.withColumn("node", node_id(F.lit("i"), F.col("entity_type"), F.col("identifier_type"), F.col("identifier_value"))))
    rows = written.df
    members = rows.where("link is not null").select("node", node_id(F.lit("e"), F.col("entity_type"), F.col("link")).alias("link"))
    labels, _ = components(star_edges(members, "link", "node"))
    nodes = rows.select("node", "entity_type", "identifier_type", "identifier_value", F.concat_ws(":", "identifier_type", "identifier_value").alias("_text")).distinct()
    roots = _union(labels).select("node", F.col("parent").alias("root")) if labels else nodes.select("node", F.col("node").alias("root")).limit(0)
    found = cut(nodes.join(roots, "node", "left")).df
    for t in (written, *labels):
        t.drop()
    linked = found.where("root is not null")
    least = linked.groupBy("root").agg(F.min("_text").alias("group_key"), F.count("*").alias("_size"))
    named = join_label(linked, least, "root", "_size", "node")
    cols = ["entity_type", "identifier_type", "identifier_value"]
    return named.select(*cols, "group_key").unionByName(found.where("root is null").select(*cols, F.col("_text").alias("group_key")))

"""Deeply nested records as an adjacency table, and flat entity tables pivoted from it.

A record is stored as nodes (node, parent, label, ordinal, kind, scalar). Everything else is derived from these columns:
paths by following the parents, rows of entities by joining object nodes with their scalar children, and one flat table
for each list path by pivoting the joined children into columns. A record's nodes are born in one task and their keys
hold the record, so both sides of the join lie in one Arrow batch already and are merged there by their sorted parents;
nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.functions.deepjson import loads, text_array

#: Keys under which one bare object stands for a list of one.
BARE_LISTS = ("parts", "data", "taxes", "rates", "locations")
#: Nodes of a batch after which it is handed on.
BATCH_NODES = 50_000

NODES = "node bigint, parent bigint, label string, ordinal int, kind string, scalar string"
ENTITIES = "entity string, node_path string, parent_path string, cells map<string,string>"
_NODE_TYPES = [("node", pa.int64()), ("parent", pa.int64()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())]


def _load(text):
    """The value of a payload; None (as for JSON null) where it is unreadable."""
    try:
        x = loads(text)
        return loads(x) if isinstance(x, str) else x
    except (ValueError, TypeError):
        return None


class Nodes:
    """The adjacency columns of some records. ``parent`` counts within ``self``, -1 for roots; a parent precedes its
    children."""

    def __init__(self):
        self.record: list[int] = []
        self.start: list[int] = []  # the first node of each node's record
        self.parent: list[int] = []
        self.label: list[str | None] = []
        self.ordinal: list[int | None] = []
        self.kind: list[str] = []
        self.scalar: list[str | None] = []

    def __len__(self) -> int:
        return len(self.parent)

    def add(self, record: int, root, bare: frozenset[str]) -> None:
        """Append the nodes of one record, iteratively, in document order, whatever the depth."""
        start = len(self.parent)
        record_, start_, parent, label, ordinal, kind, scalar = self.record, self.start, self.parent, self.label, self.ordinal, self.kind, self.scalar
        todo = [(root, -1, "$", None)]
        while todo:
            x, up, name, place = todo.pop()
            n = len(parent)
            record_.append(record)
            start_.append(start)
            parent.append(up)
            label.append(name)
            ordinal.append(place)
            if isinstance(x, dict):
                kind.append("object")
                scalar.append(None)
                for k in reversed(x):
                    v = x[k]
                    todo.append(([v] if k in bare and isinstance(v, dict) else v, n, k, None))
            elif isinstance(x, list):
                kind.append("list")
                scalar.append(None)
                todo.extend((x[i], n, None, i) for i in range(len(x) - 1, -1, -1))
            elif x is None:
                kind.append("null")
                scalar.append(None)
            else:
                kind.append("scalar")
                scalar.append(x if isinstance(x, str) else json.dumps(x))


def link(n: Nodes) -> tuple[list[int], dict[int, tuple[str, str, str | None]], list[str | None]]:
    """(owner, entities, names) of the nodes, by following ``parent``.

    entities: object elements of lists and the roots -> (list path without places, own path, path of the entity around).
    owner: the nearest entity that encloses each node. names: a node's path relative to that entity.
    """
    owner: list[int] = []
    names: list[str | None] = []
    entities: dict[int, tuple[str, str, str | None]] = {}
    # Each container's full path and list path are its entity's, continued by its name.
    for i, (up, label, place, kind) in enumerate(zip(n.parent, n.label, n.ordinal, n.kind, strict=True)):
        if up < 0:
            entities[i] = ("$", "$", None)
            owner.append(i)
            names.append("" if kind in ("object", "list") else "$")
            continue
        at = up if up in entities else owner[up]
        above = "" if up in entities else names[up]
        if place is None:
            name = f"{above}.{label}" if above else label
        else:
            name = f"{above}[{place}]"
        owner.append(at)
        names.append(name)
        if kind == "object" and place is not None:
            shape, path, _ = entities[at]
            dot = "" if name[0] == "[" and not above else "."
            inner = f"{above}[]" if at == up or not above else f"{_shape(n, up, at, names)}[]"
            entities[i] = (f"{shape}{dot}{inner}", f"{path}{dot}{name}", path)
    return owner, entities, names


def _shape(n: Nodes, node: int, entity: int, names: list[str | None]) -> str:
    """The name of ``node`` within its entity with the places of lists left out."""
    steps = []
    while node != entity:
        steps.append("[]" if n.ordinal[node] is not None else "." + n.label[node])
        node = n.parent[node]
    return "".join(reversed(steps)).removeprefix(".")


def join_children(n: Nodes, owner: list[int], entities: dict, names: list[str | None]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(entity nodes, keys, values, offsets): the scalar children of every entity, a merge join on the sorted owners."""
    kinds = np.array(n.kind)
    leaves = np.flatnonzero((kinds == "scalar") | (kinds == "null"))
    of = np.array(owner, dtype=np.int64)[leaves]
    order = np.argsort(of, kind="stable")
    leaves, of = leaves[order], of[order]
    heads = np.fromiter(entities, dtype=np.int64, count=len(entities))
    left, right = np.searchsorted(of, heads, "left"), np.searchsorted(of, heads, "right")
    offsets = np.concatenate([[0], np.cumsum(right - left)]).astype(np.int32)
    # Owners ascend with the heads, so the matched leaves are the sorted leaves themselves.
    return heads, text_array([names[i] for i in leaves]), text_array([n.scalar[i] for i in leaves]), offsets


def _run(df: DataFrame, row_id: str, raw: str, bare: tuple[str, ...], schema: str, make: Callable[[Nodes], tuple[list, np.ndarray]]) -> DataFrame:
    names = frozenset(bare)
    fields = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)

            def out(n: Nodes) -> pa.RecordBatch:
                columns, at = make(n)
                return pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(n.record, dtype=np.int64)[at])), *columns], [row_id, *fields])

            nodes = Nodes()
            for i in range(b.num_rows):
                x = _load(texts[i].as_py())
                if x is not None:
                    nodes.add(i, x, names)
                if len(nodes) > BATCH_NODES:
                    yield out(nodes)
                    nodes = Nodes()
            yield out(nodes)

    return df.select(row_id, raw).mapInArrow(run, f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, {schema}")


def shred(df: DataFrame, row_id: str, raw: str, bare: tuple[str, ...] = BARE_LISTS) -> DataFrame:
    """The adjacency table of the payloads: (row_id, node, parent, label, ordinal, kind, scalar).

    node: number within the record, the root 0. label: the key in its parent object; ordinal: the place in its parent
    list. kind: object, list, scalar or null. A payload that is null, empty or not complete JSON gives no nodes; one
    encoded once more as a JSON string counts as what it holds. Any depth is read. One parse a record, in Arrow batches,
    without a shuffle.
    """

    def make(n: Nodes) -> tuple[list, np.ndarray]:
        start, parent = np.array(n.start, dtype=np.int64), np.array(n.parent, dtype=np.int64)
        at = np.arange(len(n), dtype=np.int64)
        local = pa.array(parent - np.where(parent < 0, 0, start), pa.int64(), mask=parent < 0)
        return [pa.array(at - start, pa.int64()), local, text_array(n.label), pa.array(n.ordinal, pa.int32()), pa.array(n.kind, pa.string()), text_array(n.scalar)], at

    return _run(df, row_id, raw, bare, NODES, make)


def entity_rows(df: DataFrame, row_id: str, raw: str, bare: tuple[str, ...] = BARE_LISTS) -> DataFrame:
    """The rows of every flat table of the payloads: (row_id, entity, node_path, parent_path, cells).

    An entity is an object that is an element of a list, or a record's root (entity and node_path ``$``, parent_path
    null). ``entity`` names its table: the list path with ``[]`` for places, such as ``$.charges.data[]``. parent_path is the
    node_path of the nearest enclosing entity. cells: the scalars below the entity that lie in no inner entity, by
    their relative path (``id``, ``price.amount``, ``labels[0]``); JSON null is a null value. Every scalar of a record is in one
    cell of one row. Payloads that give no nodes give no rows.
    """

    def make(n: Nodes) -> tuple[list, np.ndarray]:
        owner, entities, names = link(n)
        heads, keys, values, offsets = join_children(n, owner, entities, names)
        rows = list(entities.values())
        cells = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), keys, values)
        return [text_array([r[0] for r in rows]), text_array([r[1] for r in rows]), text_array([r[2] for r in rows]), cells], heads

    return _run(df, row_id, raw, bare, ENTITIES, make)


def entity_table(entities: DataFrame, row_id: str, lists: str | tuple[str, ...], columns: dict[str, str] | list[str]) -> DataFrame:
    """The flat table of one kind of entity: (row_id, node_path, parent_path, columns...).

    ``lists`` names the list paths (``$.charges.data[]``) of the table, or, without a leading ``$``, the last key of lists at any
    depth (``parts``). ``columns`` are the cells pivoted to columns (name -> relative path); missing and null ones are null.
    """
    cols = columns if isinstance(columns, dict) else {c: c for c in columns}
    wanted = [lists] if isinstance(lists, str) else list(lists)
    e = F.col("entity")
    hit = F.lit(False)
    for x in wanted:
        hit = hit | ((e == x) if x.startswith("$") else e.endswith(f".{x}[]"))
    return entities.where(hit).select(row_id, "node_path", "parent_path", *[F.try_element_at("cells", F.lit(p)).alias(c) for c, p in cols.items()])

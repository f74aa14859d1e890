"""What changed between full snapshots.

Keys get persistent ordinals; a snapshot is a compressed bitmap over them (64-bit words, only non-zero ones stored) with
an ordinal-aligned vector of content fingerprints beside each word. AND-NOT of two words gives additions and removals,
comparing the vectors under the AND gives changes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idloom.functions.deepjson import loads, text_array
from idloom.storage import cut


def _number(text: str):
    """One spelling for every spelling of a number; exponents too large to write out stay as they are."""
    d = Decimal(text)
    if not d.is_finite():
        return text
    # All digits count: a context of fewer than the text has would round.
    d = d.normalize(Context(prec=max(1, len(text)), Emax=MAX_EMAX, Emin=MIN_EMIN))
    return Number(format(d, "f") if -400 < d.adjusted() < 400 else str(d)) if d else Number("0")


class Number(str):
    """A canonical number, told apart from a string."""


def _canonical(x, unordered: frozenset[str] = frozenset()) -> str:
    """Canonical JSON text: sorted keys, no blanks, one spelling of numbers; lists named in ``unordered`` (keys of the
    outermost object) are sorted."""
    if isinstance(x, Number):
        return "n" + x
    if isinstance(x, dict):
        return "{" + ",".join(json.dumps(k) + ":" + ("[" + ",".join(sorted(map(_canonical, v))) + "]" if k in unordered and isinstance(v, list) else _canonical(v)) for k, v in sorted(x.items())) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_canonical, x)) + "]"
    return json.dumps(x)


def _deep(x, unordered: frozenset[str]) -> str:
    """``_canonical`` with an explicit stack, for nesting beyond Python's recursion limit."""
    done: list[str] = []
    todo: list[tuple] = [(x, unordered, None)]
    while todo:
        v, loose, close = todo.pop()
        if close is not None:
            keys, sort = close
            n = len(v)
            parts = done[len(done) - n :]
            del done[len(done) - n :]
            if keys is None:
                done.append("[" + ",".join(sorted(parts) if sort else parts) + "]")
            else:
                done.append("{" + ",".join(json.dumps(k) + ":" + p for k, p in zip(keys, parts, strict=True)) + "}")
        elif isinstance(v, dict):
            keys = sorted(v)
            todo.append((v, None, (keys, False)))
            todo.extend((v[k], frozenset(), None) if not (k in loose and isinstance(v[k], list)) else (v[k], None, None) for k in reversed(keys))
        elif isinstance(v, list):
            todo.append((v, None, (None, loose is None)))
            todo.extend((y, frozenset(), None) for y in reversed(v))
        else:
            done.append(_canonical(v))
    return done[0]


def canonical(x, unordered: frozenset[str] = frozenset()) -> str:
    try:
        return _canonical(x, unordered)
    except RecursionError:
        return _deep(x, unordered)


def parse_object(text: str | None):
    """The object (or other JSON value) of a payload; None where it is unreadable."""
    try:
        x = loads(text, _number)
        return loads(x, _number) if isinstance(x, str) and not isinstance(x, Number) else x
    except (ValueError, TypeError, ArithmeticError):
        return None


def _text(v) -> str | None:
    return None if v is None or isinstance(v, (dict, list)) else str(v) if isinstance(v, str) else json.dumps(v)


def fingerprints(df: DataFrame, raw: str, parts: list[str], content: str, unordered: list[str]) -> DataFrame:
    """``df`` plus a column for each of ``parts`` (texts of the payload) and ``_print``: SHA-256 of the canonical JSON of
    ``content``, of null where it is missing. Unreadable payloads get nulls. Columns of ``df`` that have one of the new
    names are replaced. Arrow batches; one parse a row."""
    loose = frozenset(unordered)
    df = df.drop(*[c for c in (*parts, "_print") if c != raw])

    kept = [f for f in df.schema.fields if f.name != raw]
    names = [*[f.name for f in kept], *parts, "_print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[str, list] = {p: [] for p in (*parts, "_print")}
            for text in b.column(at).to_pylist():
                x = parse_object(text)
                ok = isinstance(x, dict)
                for p in parts:
                    got[p].append(_text(x.get(p)) if ok else None)
                got["_print"].append(hashlib.sha256(canonical(x.get(content), loose).encode("utf-8", "surrogatepass")).digest() if ok else None)
            new = [text_array(got[p]) for p in parts] + [pa.array(got["_print"], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], *new], names)

    at = df.columns.index(raw)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{p}` string" for p in parts), "_print binary"])
    return df.mapInArrow(run, schema)


def assign_ordinals(keys: DataFrame, names: list[str], known: DataFrame | None = None) -> DataFrame:
    """(names..., ordinal): the persistent ordinal of each distinct key.

    Keys in ``known`` keep theirs; new ones follow the greatest. Ordinals are dense within a sorted partition, so that
    keys of one group share words; they are given without a global sort into one task and kept by writing the table.
    """
    fresh, base = keys.select(*names).distinct(), 0
    if known is not None:
        fresh = fresh.join(known, names, "left_anti")
        top = known.agg(F.max("ordinal")).first()[0]
        base = 0 if top is None else (top // 64 + 1) * 64
    fresh = fresh.repartitionByRange(*names).sortWithinPartitions(*names).select(*names, (F.monotonically_increasing_id() + base).alias("ordinal"))
    table = cut(fresh).df
    return table if known is None else known.select(*names, "ordinal").unionByName(table)


def delivered_ordinals(rows: DataFrame, names: list[str], known: DataFrame | None, deliveries: int) -> DataFrame:
    """The ordinals after all deliveries: the rows come in slices of ``_t``, oldest first, and a key keeps the ordinal of the
    slice that brought it (or that of ``known``), so words of old snapshots stay valid when new keys arrive."""
    us = F.unix_micros(F.col("_t").cast("timestamp"))
    at = rows.agg(F.percentile_approx(us, [i / deliveries for i in range(1, deliveries)], 1000)).first()[0] if deliveries > 1 else []
    cuts = sorted({*(at or [])})
    for i in range(len(cuts) + 1):
        late, early = us > cuts[i - 1] if i else F.lit(True), us <= cuts[i] if i < len(cuts) else F.lit(True)
        known = assign_ordinals(rows.where(late & early), names, known)
    return known


def _bits(mask: str):
    """array<int>: the places of the set bits of a bigint column."""
    return F.expr(f"filter(sequence(0, 63), i -> (shiftrightunsigned({mask}, i) & 1L) = 1L)")


def snapshot_changes(df: DataFrame, group: str, key: str, at: str, content: str, order: list[str] | None = None, known: DataFrame | None = None, deliveries: int = 2) -> DataFrame:
    """(group, key, at, change): added, removed or changed keys of each group's snapshots against the one before.

    All rows of one group with the same ``at`` are one snapshot; the first has no changes. Rows with a null group, key or
    ``at`` take no part; ``known`` and ``deliveries`` as in ``delivered_ordinals``. A key repeated within a snapshot counts once, with the content of its greatest ``order``.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.struct(*[F.col(c) for c in order or []], F.col(content).alias("_c")).alias("_o"))
    rows = cut(rows.groupBy("_g", "_k", "_t").agg(F.max("_o").alias("_o")).select("_g", "_k", "_t", F.col("_o._c").alias("_c"))).df
    ordinals = delivered_ordinals(rows, ["_g", "_k"], known, deliveries)
    # A group's snapshot times are few beside its rows and are reduced map-side first.
    line = rows.groupBy("_g", "_t").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_g").orderBy("_t")
    line = line.select("_g", "_t", F.lag("_t").over(w).alias("_before"), F.lead("_t").over(w).alias("_after"))
    words = (
        rows.join(ordinals, ["_g", "_k"])
        .withColumn("_word", F.expr("ordinal div 64"))
        .withColumn("_bit", F.expr("int(ordinal % 64)"))
        .groupBy("_g", "_t", "_word")
        .agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_map"), F.map_from_entries(F.collect_list(F.struct("_bit", "_c"))).alias("_vec"))
    )
    words = words.join(line, ["_g", "_t"])
    now = words.where("_before is not null").select("_g", "_word", F.col("_t").alias("_at"), F.col("_map").alias("_m1"), F.col("_vec").alias("_v1"))
    old = words.where("_after is not null").select("_g", "_word", F.col("_after").alias("_at"), F.col("_map").alias("_m0"), F.col("_vec").alias("_v0"))
    both = now.join(old, ["_g", "_word", "_at"], "full").withColumns({"_m0": F.coalesce("_m0", F.lit(0).cast("bigint")), "_m1": F.coalesce("_m1", F.lit(0).cast("bigint"))})
    both = both.withColumns({"_add": F.expr("_m1 & ~_m0"), "_del": F.expr("_m0 & ~_m1"), "_and": F.expr("_m0 & _m1")})
    hit = F.concat(
        F.transform(_bits("_add"), lambda i: F.struct(i.alias("bit"), F.lit("added").alias("change"))),
        F.transform(_bits("_del"), lambda i: F.struct(i.alias("bit"), F.lit("removed").alias("change"))),
        F.transform(F.filter(_bits("_and"), lambda i: ~F.col("_v0")[i].eqNullSafe(F.col("_v1")[i])), lambda i: F.struct(i.alias("bit"), F.lit("changed").alias("change"))),
    )
    found = both.select("_g", "_at", "_word", F.explode(hit).alias("_h")).select("_at", (F.col("_word") * 64 + F.col("_h.bit")).alias("ordinal"), F.col("_h.change").alias("change"))
    return found.join(ordinals, "ordinal").select(F.col("_g").alias(group), F.col("_k").alias(key), F.col("_at").alias(at), "change")

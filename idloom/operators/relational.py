"""General relational operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.functions.normalize import NULL_STRINGS


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``. Give a total order where the result must be reproducible."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key as one aggregate: combined map-side, so a hot key costs one row a
    task, where a window would gather its rows."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    got = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return got.select(*keys, *[F.col("_m")[c].alias(c) for c in [*order, *rest]]).select(*df.columns)


def first_last_flags(df: DataFrame, keys: list[str], order: list[str], label: str, get: str = "first") -> DataFrame:
    """Adds is_first_<label> and/or is_last_<label> (get: first, last or both)."""
    out = df
    if get in ("first", "both"):
        out = out.withColumn(f"is_first_{label}", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])) == 1)
    if get in ("last", "both"):
        out = out.withColumn(f"is_last_{label}", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])) == 1)
    return out


def union_aligned(parts: dict[str, DataFrame] | list[DataFrame], relation_column: str | None = None) -> DataFrame:
    """Union by name, missing columns null, optionally with the name of the relation each row comes from."""
    if isinstance(parts, dict):
        frames = [d.withColumn(relation_column, F.lit(n)) if relation_column else d for n, d in parts.items()]
    else:
        frames = list(parts)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_resolving(a: DataFrame, b: DataFrame, id_a: str, id_b: str, rename: str = "non-unique", prefix: str = "b_") -> DataFrame:
    """Left join whose column clashes are resolved: rename all or the non-unique columns of ``b``, or drop the latter."""
    clash = set(a.columns)
    right = b.withColumn("_join", F.col(id_b))
    cols = []
    for c in b.columns:
        if rename == "all" or (rename == "non-unique" and c in clash):
            cols.append(F.col(c).alias(prefix + c))
        elif c not in clash:
            cols.append(F.col(c))
    right = right.select("_join", *cols)
    return a.join(right, a[id_a] == right["_join"], "left").drop("_join")


def _is_prod(target: str | None) -> bool:
    return bool(target) and (target.lower().startswith("prod") or target.lower() == "default")


def limit_by_timestamp(column: str, target: str, dev_limit: str | None = None, prod_limit: str | None = None, config_dev: str | None = None, config_prod: str | None = None) -> Column:
    """A floor on a time column by the environment: dev*, or prod* and ``default``. The limits given override the configured
    ones; true where none is set."""
    dev = bool(target) and target.lower().startswith("dev")
    floor = (dev_limit or config_dev) if dev else (prod_limit or config_prod) if _is_prod(target) else None
    return F.col(column) >= F.lit(floor).cast("timestamp_ntz") if floor else F.lit(True)


def unpivot_identifiers(
    df: DataFrame, columns: list[str] | None = None, exclude: list[str] = (), event_id: str = "event_id", edge_id: str = "edge_id", types: dict[str, str] | None = None, role: str | None = None,
    entity_type: str = "person", source: str = "source", occurred_at: str = "occurred_at", extra: list[str] = (), id_columns: list[str] = (), limit: int | None = None, target: str | None = None,
) -> DataFrame:
    """One row per non-null identifier column, from a single scan; null-like texts are dropped.

    ``id_columns``: further columns of ``extra`` that tell ids apart. ``limit``: input rows read outside production, for
    development; ``target`` prod* or ``default`` reads all.
    """
    types = types or {}
    if limit is not None and not _is_prod(target):
        df = df.limit(limit)
    cols = columns or [c for c in df.columns if c not in {event_id, edge_id, source, occurred_at, "_ingested_at", *exclude, *extra, *([role] if role else [])}]
    cells = F.explode(F.array(*[F.struct(F.lit(types.get(c, c)).alias("t"), F.col(c).cast("string").alias("v")) for c in cols]))
    base = df.select(F.col(event_id).alias("event_id"), F.col(edge_id).alias("_edge"), F.col(source).alias("source"), F.col(occurred_at).alias("occurred_at"), "_ingested_at", (F.col(role) if role else F.lit(None).cast("string")).alias("role"), *extra, cells.alias("_c"))
    base = base.where(F.col("_c.v").isNotNull() & ~F.col("_c.v").isin(*NULL_STRINGS))
    return base.select(
        make_id("entity_identifier", "event_id", F.col("_c.v"), "role", "occurred_at", F.col("_c.t"), *id_columns).alias("entity_identifier_id"), "event_id", make_id("entity_edge", "_edge", F.lit(entity_type)).alias("edge_id"),
        F.lit(entity_type).alias("entity_type"), F.col("_c.t").alias("identifier_type"), F.col("_c.v").alias("identifier_value"), "role", "source", "occurred_at", "_ingested_at", *extra,
    )


def unpivot_traits(
    df: DataFrame, columns: list[str] | None, identifier: str, identifier_type: str, names: dict[str, str] | None = None, event_id: str = "event_id", entity_type: str = "person", source: str = "source", occurred_at: str = "occurred_at",
    exclude: list[str] = (), extra: list[str] = (), limit: int | None = None, target: str | None = None,
) -> DataFrame:
    """One row per non-null trait column, keyed by an identifier column. Without ``columns`` all but the fixed, excluded and
    extra ones; ``limit`` as in ``unpivot_identifiers``."""
    names = names or {}
    if limit is not None and not _is_prod(target):
        df = df.limit(limit)
    columns = columns or [c for c in df.columns if c not in {event_id, identifier, source, occurred_at, "_ingested_at", *exclude, *extra}]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("raw"), F.lit(names.get(c, c)).alias("n"), F.col(c).cast("string").alias("v")) for c in columns]))
    base = df.select(*extra, F.col(event_id).alias("event_id"), F.col(identifier).cast("string").alias("identifier_value"), F.col(source).alias("source"), F.col(occurred_at).alias("occurred_at"), cells.alias("_c"))
    base = base.where(F.col("_c.v").isNotNull() & ~F.col("_c.v").isin(*NULL_STRINGS) & F.col("identifier_value").isNotNull())
    return base.select(
        make_id("entity_trait", "event_id", "identifier_value", F.lit(entity_type), F.col("_c.raw"), F.lit(identifier_type)).alias("entity_trait_id"), "event_id", F.lit(entity_type).alias("entity_type"),
        F.lit(identifier_type).alias("identifier_type"), "identifier_value", F.col("_c.n").alias("trait_name"), F.col("_c.v").alias("trait_value"), "source", "occurred_at", *extra,
    )


def column_name(trait: str) -> str:
    return trait.lower().replace(" ", "_")


def pivot_eav(df: DataFrame, keys: list[str], name: str, value: str, names: list[str] | None = None, prefix: str = "") -> DataFrame:
    """EAV rows to a wide table, max(value) per cell; names are discovered and sorted where not given. Names that give one
    column are coalesced."""
    if names is None:
        names = sorted(r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().collect())
    cells: dict[str, Column] = {}
    for n in names:
        cells.setdefault(column_name(n), F.lit(False))
    groups = {c: [n for n in names if column_name(n) == c] for c in cells}
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name).isin(*ns), F.col(value))).alias(prefix + c) for c, ns in groups.items()])


def register_entities(df: DataFrame, entity_type: str, source: str, source_id: str, traits: list[str] = (), created_at: str | None = None, updated_at: str | None = None) -> DataFrame:
    """Deterministic entity rows of a source table that needs no resolution."""
    ts = lambda c: (F.col(c) if c else F.lit(None)).cast("timestamp_ntz")
    return df.select(
        make_id("entity", F.col(source_id), F.lit(source)).alias("entity_id"), F.lit(entity_type).alias("entity_type"), F.lit(source).alias("source"), F.col(source_id).cast("string").alias("source_id"),
        *traits, ts(created_at).alias("created_at"), ts(updated_at).alias("updated_at"),
    )


def snapshot_diff_events(df: DataFrame, key: str, value: str, name: str, event_type: str, source: str, observed_at: str = "_ingested_at", mode: str = "value", grain: str = "distinct_value", extra: dict[str, str] | None = None) -> DataFrame:
    """Events rebuilt from append-only snapshots: one per distinct (key, value), or one per run of equal values."""
    if grain == "change" and mode == "value":
        raise ValueError("grain 'change' needs occurred_at mode 'observed'")
    v = F.col(value).cast("string")
    rows = df.where(F.col(key).isNotNull() & v.isNotNull() & (F.trim(v) != "")).select(F.col(key).cast("string").alias("_key"), v.alias("_value"), F.col(observed_at).alias("_at"), *[F.col(c).alias(a) for a, c in (extra or {}).items()])
    run_key = []
    if grain == "change":
        w = Window.partitionBy("_key").orderBy("_at", "_value")
        prev = F.lag("_value").over(w)
        rows = rows.withColumn("_start", F.when(prev.isNull() | (prev != F.col("_value")), 1).otherwise(0)).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_start = 1")
        run_key = ["_run"]
    out = rows.groupBy("_key", "_value", *run_key).agg(F.min("_at").alias("_first"), *[F.max(a).alias(a) for a in extra or {}])
    occurred = F.col("_first") if mode == "observed" else F.col("_value").try_cast("timestamp_ntz")
    return out.select(make_id("event", "_key", "_value", *run_key, F.lit(name)).alias("event_id"), F.col("_key").alias("entity_key"), F.col("_value").alias("value"), F.lit(name).alias("event_name"), F.lit(event_type).alias("event_type"), F.lit(source).alias("source"), occurred.alias("occurred_at"), F.col("_first").alias("_ingested_at"), *(extra or {}))


def zscores(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Adds <measure>_z within groups and max_abs_z; null where a group has no spread. Group statistics are joined back, so a
    large group is not gathered."""
    stats = df.groupBy(*by).agg(*[f(m).alias(f"_{m}_{n}") for m in measures for f, n in ((F.avg, "avg"), (F.stddev_samp, "sd"))])
    out = df.join(stats, by)
    for m in measures:
        out = out.withColumn(f"{m}_z", (F.col(m) - F.col(f"_{m}_avg")) / F.nullif(F.col(f"_{m}_sd"), F.lit(0.0)))
    top = F.greatest(*[F.abs(f"{m}_z") for m in measures], F.lit(None).cast("double")) if len(measures) > 1 else F.abs(f"{measures[0]}_z")
    return out.withColumn("max_abs_z", top).drop(*[f"_{m}_{n}" for m in measures for n in ("avg", "sd")])


def where(filters: list[dict]) -> Column:
    """AND of {column, operator, value} filters: = != > < >= <= LIKE IN IS NULL IS NOT NULL."""
    out = F.lit(True)
    for f in filters:
        c, op, v = F.col(f["column"]), f["operator"].upper(), f.get("value")
        if op == "IS NULL":
            p = c.isNull()
        elif op == "IS NOT NULL":
            p = c.isNotNull()
        elif op == "IN":
            if not isinstance(v, (list, tuple)):
                raise ValueError("IN needs a list")
            p = c.isin(*v)
        elif v is None:
            raise ValueError(f"{op} needs a value")
        elif op == "LIKE":
            p = c.like(v)
        elif op in ("=", "!=", ">", "<", ">=", "<="):
            p = {"=": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]
        else:
            raise ValueError(f"unknown operator {op}")
        out = out & p
    return out


def select_where(df: DataFrame, filters: list[dict] = (), order: list[Column] = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Filters, order, offset and limit."""
    out = df.where(where(list(filters))) if filters else df
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table of a contract without rows."""
    return spark.createDataFrame([], schema)


def union_or_empty(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """The union by name, cut to the contract's columns; the typed empty table where there is nothing to unite."""
    if not parts:
        return empty(spark, schema)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return union_aligned(parts).select(*names)


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): keys held by more than one row, nulls included. Empty where the key is unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def reference_violations(df: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """(columns, n): values without a row in ``parent``; rows with a null among the columns refer to nothing and are left
    out. Values are counted before the join, so a hot one is one row."""
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).groupBy(*columns).agg(F.count("*").alias("n"))
    return whole.join(parent.select(*[F.col(k).alias(c) for k, c in zip(keys, columns, strict=True)]).distinct(), columns, "left_anti")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns): rows that only one of two relations holds, copies counting once."""
    cols = sorted(a.columns)
    x, y = a.select(*cols), b.select(*cols)
    return x.subtract(y).withColumn("side", F.lit("a")).unionByName(y.subtract(x).withColumn("side", F.lit("b")))


def group_pairs(df: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b): each member with the least of its group, the pairs from which all others of the group follow. Comparing two
    partitions needs no more, and a group costs its members instead of their square."""
    least = df.groupBy(group).agg(F.min(member).alias("a"))
    return df.join(least, group).select("a", F.col(member).alias("b")).where("a <> b").distinct()

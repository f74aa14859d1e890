"""Temporal states: wide timelines, as-of participation and derived states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.operators.relational import column_name
from idloom.operators.timeline import carry_last


def entity_states(states: DataFrame, dimension_names: list[str], measure_names: list[str]) -> DataFrame:
    """The timeline of each entity: one row from each change point on, with the value of every state then.

    A change point is a time a state is entered or left. A state holds at t if entered <= t and not left by t; of several
    of one name the latest entered (then the greatest state_id) counts. Points without any active state give no row.

    States of one name rarely overlap: then entering and leaving are put on one line per entity and carried forward, so
    the work is linear. Where they do, the points of that entity are compared with the overlapping states of that name.
    """
    keys = ["entity_id", "entity_type", "valid_from"]
    own = ["entity_id", "entity_type", "state_name"]
    names = sorted({*dimension_names, *measure_names})
    valued = (F.col("state_value").isNotNull() | F.col("state_numeric_value").isNotNull()) & F.col("state_entered_at").isNotNull() & (F.col("state_exited_at").isNull() | (F.col("state_exited_at") > F.col("state_entered_at")))
    s = states.withColumn("_held", F.coalesce(valued, F.lit(False)))
    reach = F.max(F.when(F.col("_held"), F.coalesce("state_exited_at", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")))).over(Window.partitionBy(*own).orderBy("state_entered_at", "state_id").rowsBetween(Window.unboundedPreceding, -1))
    meets = s.withColumn("_reach", reach).where("_held and _reach > state_entered_at").select(*own).distinct().withColumn("_meets", F.lit(True))
    # States of names without a column still make a point count; they take the general way.
    s = s.join(meets, own, "left").withColumn("_mixed", F.col("_meets").isNotNull() | ~F.coalesce(F.col("state_name").isin(*names), F.lit(False)))
    # Without overlaps at most one state of a name holds; it begins at its entry and ends with an empty cell. One pass gives
    # all points, with the cells that change there.
    plain = F.col("_held") & ~F.col("_mixed")
    cell = lambda on: F.when(plain, F.struct("state_name", F.when(F.lit(on), F.col("state_value")).alias("state_value"), F.when(F.lit(on), F.col("state_numeric_value")).alias("state_numeric_value"), F.lit(on).alias("on")))
    ends = F.explode(F.array(F.struct(F.col("state_entered_at").alias("t"), F.lit(2).alias("_k"), cell(True).alias("c")), F.struct(F.col("state_exited_at").alias("t"), F.lit(1).alias("_k"), cell(False).alias("c"))))
    steps = s.select("entity_id", "entity_type", ends.alias("e")).select("entity_id", "entity_type", F.col("e.t").alias("valid_from"), F.col("e._k").alias("_k"), F.col("e.c").alias("c")).where("valid_from is not null")
    changes = steps.groupBy(*keys).agg(F.lit(1).alias("_one"), *[F.max(F.when(F.col("c.state_name") == n, F.struct("_k", "c"))).alias(f"_c{i}") for i, n in enumerate(names)]).drop("_one")
    rest = s.where("_held and _mixed")
    near = rest.select("entity_id", "entity_type").distinct()
    points = states.join(near, ["entity_id", "entity_type"], "left_semi").select("entity_id", "entity_type", F.explode(F.array("state_entered_at", "state_exited_at")).alias("valid_from")).where("valid_from is not null").distinct()
    held = points.join(rest, ["entity_id", "entity_type"]).where("state_entered_at <= valid_from and (state_exited_at is null or state_exited_at > valid_from)")
    top = held.groupBy(*keys, "state_name").agg(F.max(F.struct("state_entered_at", "state_id", "state_value", "state_numeric_value")).alias("m"))
    slots = [f"_c{i}" for i in range(len(names))]
    line = carry_last(changes, ["entity_id", "entity_type"], "valid_from", [], slots)
    general = top.groupBy(*keys).agg(F.lit(True).alias("_any"), *[F.max(F.when(F.col("state_name") == n, F.struct("m.state_value", "m.state_numeric_value"))).alias(f"_m{i}") for i, n in enumerate(names)])
    both = line.join(general, keys, "left")
    on = [F.coalesce(F.col(f"_last__c{i}.c.on"), F.lit(False)) for i in range(len(names))]
    both = both.where(reduce(lambda x, y: x | y, on, F.col("_any").isNotNull()))
    # A name of an entity goes one way or the other, never both.
    value = lambda n, field: F.coalesce(F.when(on[names.index(n)], F.col(f"_last__c{names.index(n)}.c.{field}")), F.col(f"_m{names.index(n)}.{field}"))
    wide = both.select(*keys, *[value(n, "state_value").alias(column_name(n)) for n in dimension_names], *[value(n, "state_numeric_value").alias(column_name(n)) for n in measure_names])
    w = Window.partitionBy("entity_id").orderBy("valid_from", "entity_type")
    deltas = [(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))).alias(c + "_delta") for c in map(column_name, measure_names)]
    sid = make_id("entity_state", "entity_id", "valid_from")
    out = wide.withColumn("entity_state_id", sid).select("entity_state_id", *wide.columns, *deltas, F.lead("valid_from").over(w).alias("valid_to"), F.lag("entity_state_id").over(w).alias("previous_entity_state_id"))
    return out.withColumn("is_current", F.col("valid_to").isNull())


def event_states(participants: DataFrame, timeline: DataFrame, start=None, end=None) -> DataFrame:
    """(event_id, entity_id, entity_type, occurred_at, entity_state_id): the state each event met. At a change the state
    before it counts (valid_from < t <= valid_to).

    Both sides are put on one line per entity and the last state is carried forward, so no range join multiplies rows.
    """
    p = participants.select("event_id", "entity_id", "entity_type", "occurred_at").where("occurred_at is not null").distinct()
    if start is not None:
        p = p.where(F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        p = p.where(F.col("occurred_at") < F.lit(end).cast("timestamp_ntz"))
    a = p.select("entity_id", "entity_type", F.col("occurred_at").alias("_t"), F.lit(0).alias("_k"), "event_id", F.lit(None).cast("string").alias("_s"))
    b = timeline.select("entity_id", "entity_type", F.col("valid_from").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("string").alias("event_id"), F.col("entity_state_id").alias("_s"))
    # At equal times events (0) come before states (1): the previous state wins.
    out = carry_last(a.unionByName(b), ["entity_id", "entity_type"], "_t", ["_k"], ["_s"]).withColumnRenamed("_last__s", "entity_state_id").where("_k = 0 and entity_state_id is not null")
    return out.select("event_id", "entity_id", "entity_type", F.col("_t").alias("occurred_at"), "entity_state_id")


def derived_state(name: str, components: list[tuple[str, DataFrame, Column | str]], combination: Column | str, entity_type: str = "group") -> DataFrame:
    """A state combined from component states.

    components: (name, states, condition that makes it active). ``combination`` sees current_<name>_status, carried forward
    since the component was last seen (null before). A transition starts a state, the next one ends it.
    """
    cond = lambda c: F.expr(c) if isinstance(c, str) else c
    rows = None
    for k, (n, df, c) in enumerate(components):
        r = df.where(F.col("entity_type") == entity_type).select("entity_id", F.col("state_entered_at").alias("_t"), F.lit(k).alias("_k"), "trigger_event_id", *[(cond(c) if m == n else F.lit(None).cast("boolean")).alias("_" + m) for m, _, _ in components])
        rows = r if rows is None else rows.unionByName(r)
    order = ["_t", "_k", "trigger_event_id"]
    carry = Window.partitionBy("entity_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.last("_" + n, ignorenulls=True).over(carry).alias(f"current_{n}_status") for n, _, _ in components])
    rows = rows.withColumn("_v", cond(combination))
    w = Window.partitionBy("entity_id").orderBy(*order)
    kept = rows.withColumn("_p", F.lag("_v").over(w)).where("_p is null or _v <> _p")
    kept = kept.withColumn("state_exited_at", F.lead("_t").over(w)).where("_v is not null")
    return kept.select("entity_id", F.lit(entity_type).alias("entity_type"), F.lit(name).alias("state_name"), F.col("_v").alias("state_value"), F.col("_t").alias("state_entered_at"), "state_exited_at", F.col("state_exited_at").isNull().alias("is_current"), "trigger_event_id")

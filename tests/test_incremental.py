import datetime
import random

import pytest

from idloom.operators.graph import identifier_edges, propagate, resolve
from idloom.streaming.incremental import MAPPING, State, full_state, participants_step, resolve_batch, resolver_sink, upgrade_guard

T0 = datetime.datetime(2023, 1, 1)
SCHEMA = "event_id string, edge_id string, entity_type string, identifier_type string, identifier_value string, role string, source string, occurred_at timestamp_ntz, _ingested_at timestamp_ntz"


def ids(spark, rows):
    """rows: (day, edge, [(type, value)], entity type)"""
    out = [(e, e, et, t, v, "r", "s", T0 + datetime.timedelta(days=d), T0 + datetime.timedelta(days=d)) for d, e, pairs, et in rows for t, v in pairs]
    return spark.createDataFrame(out, SCHEMA)


def replay(spark, rows, kind="person"):
    all_ids = ids(spark, rows)
    days = sorted({r[0] for r in rows})
    state = full_state(all_ids.where(f"_ingested_at <= timestamp_ntz'{T0 + datetime.timedelta(days=days[0])}'"), kind)
    log = []
    for d in days[1:]:
        state, changes = resolve_batch(state, all_ids.where(f"_ingested_at <= timestamp_ntz'{T0 + datetime.timedelta(days=d)}'"), kind)
        log += [r.resolution_reason for r in changes.collect()]
    return state, log, all_ids


SCENARIOS = {
    "birth": ([(0, "e1", [("email", "a")], "person"), (1, "e2", [("email", "b")], "person")], 2, {"born": 1}),
    "accretion": ([(0, "e1", [("email", "a")], "person"), (1, "e2", [("email", "a"), ("anon", "x")], "person")], 1, {"accreted": 1}),
    "merge": ([(0, "e1", [("email", "a"), ("anon", "x")], "person"), (0, "e2", [("email", "b"), ("anon", "y")], "person"), (1, "e3", [("anon", "x"), ("anon", "y")], "person")], 1, {"repointed": 2}),
    "chain": ([(0, f"e{i}", [("email", c), ("anon", c)], "person") for i, c in enumerate("abc")] + [(1, "b1", [("anon", "a"), ("id", "1"), ("anon", "b")], "person"), (1, "b2", [("anon", "b"), ("id", "2"), ("anon", "c")], "person")], 1, {"accreted": 2, "repointed": 4}),
    "reobserved": ([(0, "e1", [("email", "a")], "person"), (1, "e2", [("email", "a")], "person"), (2, "e3", [("email", "b")], "person")], 2, {"born": 1}),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    rows, entities, log = SCENARIOS[name]
    state, got, _ = replay(spark, rows)
    s = state.collect()
    assert len({r.entity_id for r in s}) == entities
    assert {k: got.count(k) for k in set(got)} == log
    assert len({(r.identifier_type, r.identifier_value) for r in s}) == len(s)


def test_types_do_not_mix_and_empty_step(spark):
    rows = [(0, "e1", [("email", "a")], "person"), (1, "e2", [("domain", "a"), ("domain", "b")], "group"), (1, "e2", [("email", "b")], "person")]
    state, _, all_ids = replay(spark, rows)
    assert {(r.identifier_value) for r in state.collect()} == {"a", "b"} and len({r.entity_id for r in state.collect()}) == 2
    again, log = resolve_batch(state, all_ids, "person")
    assert again is state and log.count() == 0


def test_random_slicings_give_the_full_partition(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(4), f"e{i}", [("t", str(rnd.randrange(25))) for _ in range(2)], "person") for i in range(25)]
    state, _, all_ids = replay(spark, rows)
    part = lambda df: {frozenset((r.identifier_type, r.identifier_value) for r in g) for g in _groups(df)}
    assert part(state) == part(resolve(all_ids, "person", None))


def _groups(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.entity_id, []).append(r)
    return by.values()


def test_depth_bound_and_pairs(spark):
    chain = ids(spark, [(0, f"e{i}", [("t", f"{i:02}"), ("t", f"{i + 1:02}")], "person") for i in range(8)])
    for k in (1, 3, 8):
        assert len({r.entity_id for r in resolve(chain, "person", k).collect()}) == max(1, 9 - k)
        assert {(r.identifier_value, r.entity_id) for r in resolve(chain, "person", k).collect()} == {(r.identifier_value, r.entity_id) for r in resolve(chain, "person", k, identifier_edges(chain)).collect()}
    e = spark.createDataFrame([], "node string, link string")
    assert propagate(e.select("node"), e, 3).count() == 0


def test_state_versions_and_sink(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    assert state.version() == -1 and state.read(MAPPING).count() == 0
    sink = resolver_sink(state, str(tmp_path / "log"), "person")
    sink(ids(spark, [(0, "e1", [("email", "a"), ("anon", "x")], "person")]), 0)
    sink(ids(spark, [(1, "e2", [("email", "b"), ("anon", "x")], "person")]), 1)
    assert state.read(MAPPING).count() == 3 and len({r.entity_id for r in state.read(MAPPING).collect()}) == 1
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    # A batch run again changes neither the state nor its log; one that failed before the state was written gives the same.
    again = ids(spark, [(1, "e2", [("email", "b"), ("anon", "x")], "person")])
    sink(again, 1)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3 and state.version() == 1 and state.batch() == 1
    late = ids(spark, [(2, "e3", [("email", "c")], "person")])
    state_write, state.write = state.write, lambda *a: (_ for _ in ()).throw(RuntimeError)
    with pytest.raises(RuntimeError):
        sink(late, 2)
    state.write = state_write
    sink(late, 2)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4 and state.read(MAPPING).count() == 4
    with pytest.raises(ValueError, match="lacks"):
        upgrade_guard(state.read(MAPPING), ["nothing"])


def test_participants_follow_merges(spark):
    rows = [(0, "e1", [("email", "a")], "person"), (0, "e2", [("email", "b")], "person"), (1, "e3", [("email", "a"), ("email", "b")], "person"), (1, "e1", [("email", "a")], "person")]
    all_ids = ids(spark, rows)
    early = all_ids.where(f"_ingested_at <= timestamp_ntz'{T0}'")
    state = full_state(early, "person")
    none = spark.createDataFrame([], "entity_participant_id string, entity_type string, event_id string, entity_id string, role string, occurred_at timestamp_ntz, _ingested_at timestamp_ntz")
    shops = {"shop": spark.createDataFrame([("shp_1", "7")], "entity_id string, source_id string")}
    extra = ids(spark, [(0, "e9", [("source_id", "7"), ("source_id", "8")], "shop")])
    no_log = spark.createDataFrame([], MAPPING)
    first, mark, log_mark = participants_step(none, early.unionByName(extra), state, no_log, shops)
    assert first.count() == 3 and mark == T0 and log_mark is None
    assert [(r.event_id, r.entity_id) for r in first.where("entity_type = 'shop'").collect()] == [("e9", "shp_1")]
    state2, log = resolve_batch(state, all_ids, "person")
    # e1 is ingested again after the merge: its row exists at its grain, so it isn't added under a new id.
    second, mark2, log_mark2 = participants_step(first, all_ids, state2, log, shops, mark, log_mark)
    got = second.where("entity_type = 'person'").collect()
    assert len({r.entity_id for r in got}) == 1 and sorted(r.event_id for r in got) == ["e1", "e2", "e3"]
    assert len({r.entity_participant_id for r in got}) == 3 and mark2 > mark and log_mark2 == mark2
    third, *_ = participants_step(second, all_ids, state2, log, shops, mark2, log_mark2)
    assert sorted(map(tuple, third.collect()), key=str) == sorted(map(tuple, second.collect()), key=str)

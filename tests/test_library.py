import os

import duckdb
import pytest

import __spark_entry__ as entry
from idloom.config import Config
from idloom.operators.eventlog import require_ingested_at
from idloom.operators.relational import pivot_eav, snapshot_diff_events, where, zscores

SF = "/root/testdata/sf0.001"
#: A spread of the queries with SQL; the driver compares all.
CHECKED = ["p3_found", "p4_found", "event_log", "identifier_edges", "resolved_persons_k2", "relationships", "event_dimensions", "entity_states", "touchpoint_paths", "norm_email", "mail_messages_by_account", "web_touchpoints"]


def norm(v):
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == cols
    want = sorted(str(tuple(norm(x[at.index(c)]) for c in cols)) for x in r.fetchall())
    assert sorted(str(tuple(norm(x[c]) for c in cols)) for x in df.collect()) == want


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_grammar_misuse():
    with pytest.raises(ValueError):
        where([{"column": "a", "operator": "IN", "value": "x"}])
    with pytest.raises(ValueError):
        where([{"column": "a", "operator": "=", "value": None}])
    with pytest.raises(ValueError):
        where([{"column": "a", "operator": "~", "value": 1}])


def test_contracts(spark):
    a = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="a, b"):
        require_ingested_at({"b": a, "a": a})
    with pytest.raises(ValueError):
        snapshot_diff_events(a, "x", "x", "n", "t", "s", grain="change", mode="value")
    c = Config.of({"person": {"entity_resolution": True}, "shop": {"entity_resolution": False, "registration_model": "shops"}})
    assert c.resolved_types() == ["person"] and c.registered_types() == ["shop"] and not c.is_resolved("shop")
    assert Config.of(["person"]).resolved_types() == ["person"]


def test_pivot_coalesces_clashing_names(spark):
    df = spark.createDataFrame([("e", "My Trait", "1"), ("f", "my_trait", "2"), ("g", None, "3")], "id string, n string, v string")
    assert {tuple(r) for r in pivot_eav(df, ["id"], "n", "v").collect()} == {("e", "1"), ("f", "2"), ("g", None)}


def test_zscores_of_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 2.0)], "g string, m double")
    assert sorted(((r.g, r.m_z) for r in zscores(df, ["g"], ["m"]).collect()), key=str)[0] == ("a", None)

import json

from pyspark.sql import functions as F

from idloom.functions.deepjson import loads_deep
from idloom.operators.shred import entity_rows, entity_table, shred


def elements(df, row_id="row_id"):
    return df.where("entity <> '$'").select(row_id, "node_path", "parent_path")


def test_nodes_and_parents(spark):
    rec = {"a": {"data": {"x": 1, "items": [{"y": 2}, 3, None, {"z": []}]}}, "l": [[{"q": 1}], {"r": {"s": [{}]}}], "t.u": [{"k[0]": [{"v": "w"}]}], "empty": [], "none": None, "str": '[{"no": 1}]'}
    raw = json.dumps(rec)
    df = spark.createDataFrame([(1, raw, 9), (2, json.dumps(raw), 9), (3, None, 9), (4, "", 9), (5, raw[:-1], 9), (6, "[{}]", 9), (7, '"text"', 9), (8, "17", 9)], "row_id bigint, raw string, node int")
    got = sorted(map(tuple, elements(entity_rows(df, "row_id", "raw")).collect()))
    one = [
        ("$.a.data[0]", "$"), ("$.a.data[0].items[0]", "$.a.data[0]"), ("$.a.data[0].items[3]", "$.a.data[0]"), ("$.l[0][0]", "$"), ("$.l[1]", "$"), ("$.l[1].r.s[0]", "$.l[1]"), ("$.t.u[0]", "$"), ("$.t.u[0].k[0][0]", "$.t.u[0]"),
    ]
    assert got == sorted([(i, *x) for i in (1, 2) for x in one] + [(6, "$[0]", "$")])
    shapes = {r.entity for r in entity_rows(df, "row_id", "raw").where("row_id = 1").collect()}
    assert shapes == {"$", "$.a.data[]", "$.a.data[].items[]", "$.l[][]", "$.l[]", "$.l[].r.s[]", "$.t.u[]", "$.t.u[].k[0][]"}


def test_round_trip(spark):
    rec = {"a": [1, 2.5, {"b": None, "c": [[], {}]}], "d": "é😀", "e": {"f": True}}
    df = spark.createDataFrame([(1, json.dumps(rec))], "row_id bigint, raw string")
    nodes = {r.node: r for r in shred(df, "row_id", "raw").collect()}

    def build(n):
        r = nodes[n]
        kids = [x for x in nodes.values() if x.parent == n]
        if r.kind == "object":
            return {k.label: build(k.node) for k in kids}
        if r.kind == "list":
            return [build(k.node) for k in sorted(kids, key=lambda k: k.ordinal)]
        return None if r.kind == "null" else r.scalar

    assert build(0) == {"a": ["1", "2.5", {"b": None, "c": [[], {}]}], "d": "é😀", "e": {"f": "true"}}


def test_cells_are_the_join_of_the_adjacency_table(spark):
    """The merge join within batches gives what joining the written adjacency table would."""
    recs = [{"id": i, "x": {"y": {"z": i}}, "l": [1, [2, {"q": None}]], "items": [{"n": k, "sub": [{"m": k}, {"m": None, "o": {"p": "t"}}]} for k in range(i % 4)]} for i in range(40)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "row_id bigint, raw string")
    n = shred(df, "row_id", "raw")
    objects = n.where("kind = 'object' and (ordinal is not null or parent is null)").select("row_id", "node")
    direct = objects.join(n.where("kind in ('scalar', 'null') and label is not null").select("row_id", F.col("parent").alias("node"), "label", "scalar"), ["row_id", "node"])
    want = sorted(map(tuple, direct.select("row_id", "label", "scalar").collect()), key=str)
    e = entity_rows(df, "row_id", "raw").select("row_id", F.explode("cells"))
    got = sorted(map(tuple, e.where("key not like '%.%' and key not like '%[%'").collect()), key=str)
    assert got == want and want
    leaves = n.where("kind in ('scalar', 'null')").count()
    assert e.count() == leaves  # every scalar is in one cell
    row = entity_rows(df, "row_id", "raw").where("row_id = 1 and node_path = '$'").first()
    assert row.cells == {"id": "1", "x.y.z": "1", "l[0]": "1", "l[1][0]": "2"} and row.parent_path is None


def test_entity_table_and_depth(spark):
    rec = {"charges": {"data": [{"id": "c1", "amount": 5, "price": {"unit": "EUR"}, "refunds": {"data": {"id": "r1", "x": 1}}}, {"id": None}]}}
    deep = "[" * 100_000 + "]" * 100_000
    df = spark.createDataFrame([(1, json.dumps(rec)), (2, deep), (3, "[" * 500 + "{}" + "]" * 500), (4, deep[:-1])], "row_id bigint, raw string")
    e = entity_rows(df.where("row_id <> 2"), "row_id", "raw")
    got = sorted(map(tuple, entity_table(e, "row_id", "data", {"id": "id", "amount": "amount", "unit": "price.unit"}).collect()), key=str)
    assert got == [(1, "$.charges.data[0]", "$", "c1", "5", "EUR"), (1, "$.charges.data[0].refunds.data[0]", "$.charges.data[0]", "r1", None, None), (1, "$.charges.data[1]", "$", None, None, None)]
    refunds = entity_table(e, "row_id", "$.charges.data[].refunds.data[]", ["id"])
    assert [tuple(r) for r in refunds.collect()] == [(1, "$.charges.data[0].refunds.data[0]", "$.charges.data[0]", "r1")]
    assert elements(e).where("row_id = 3").count() == 1
    assert entity_rows(df.limit(0), "row_id", "raw").count() == 0
    assert shred(df, "row_id", "raw").where("row_id = 2").count() == 100_000  # nesting beyond the standard parser's depth
    assert shred(df, "row_id", "raw").where("row_id = 4").count() == 0


def test_deep_parser_reads_as_the_standard_one():
    for x in ('{"a": [1, -2.5e3, {"b": null}], "c": "\\u00e9\\n", "d": {}, "e": [ ], "f": true}', " [] ", "17", '"x"', '{"a":1,"a":2}', "[[[1]],[2,[3]]]"):
        assert loads_deep(x) == json.loads(x)
    for x in ("", "{", "[1,]", '{"a" 1}', "[1 2]", "01", '{"a":1}}', "nul", '"x', "[NaN]", "{,}", '{"a":}'):
        try:
            loads_deep(x)
        except ValueError:
            continue
        raise AssertionError(x)

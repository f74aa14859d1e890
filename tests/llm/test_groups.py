import random

from pyspark.sql import functions as F

from idloom.llm.groups import boruvka, group_identifiers
from idloom.operators import skew

SCHEMA = "entity_type string, edge string, identifier_type string, identifier_value string, node string, group_key string"


def brute(rows):
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    ids = set()
    for et, e, t, v in rows:
        v = v.strip(" \t\r\n").lower() if v is not None else None
        if et is None or t is None or v in (None, "", "null", "none"):
            continue
        ids.add((et, t, v))
        find((et, t, v))
        if e is not None:
            par[find((et, t, v))] = find((et, e))
    least = {}
    for i in ids:
        s = f"{i[1]}:{i[2]}"
        least[find(i)] = min(least.get(find(i), s), s)
    return sorted((*i, least[find(i)]) for i in ids)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, group_identifiers(df, "entity_type", "edge", "identifier_type", "identifier_value").collect()))


def test_random_graphs_hubs_and_dirt(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["p", "g", None]), rnd.choice([None, *map(str, range(40))]), rnd.choice(["a", "b", None]), rnd.choice([None, "", " NULL ", "x", " X", *map(str, range(60))])) for _ in range(200)]
    rows += [("p", "hub", "h", str(i)) for i in range(300)] + [("p", "hub", "h", "1")] * 5
    assert run(spark, rows) == brute(rows)


def test_long_chain(spark):
    rows = [("p", f"e{i}", "t", f"{(i + k) * 7919 % 400:03}") for i in range(399) for k in (0, 1)]
    assert run(spark, rows) == brute(rows)


def test_rounds_grow_with_the_logarithm(spark):
    n = 256
    e = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(n)] + [("x", None), ("y", "y")], "u string, v string")
    roots, rounds = boruvka(e.union(e.select("v", "u")))
    got = roots.collect()
    assert rounds <= 8 and len({r.root for r in got}) == 1 and len(got) == n + 1


def test_empty(spark):
    assert run(spark, []) == []
    assert boruvka(spark.createDataFrame([], "u string, v string"))[1] == 0


def test_hot_labels_join_in_parts(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    labels = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("label", F.upper("k"))
    got = skew.join_label(rows, labels, "k", "n", "id", hot_rows=100)
    assert got.count() == 1000 and got.where("label = 'HOT'").count() == 700 and got.where("label is null").count() == 0


def test_hubs_join_in_parts(spark, monkeypatch):
    """With every key of more than a few rows split, the groups stay the same."""
    monkeypatch.setattr(skew.join_even, "__defaults__", (5, None))
    rows = [("p", "hub", "h", str(i)) for i in range(120)] + [("p", f"e{i}", "h", str(i % 120)) for i in range(200)] + [("p", f"e{i}", "t", str(i // 3)) for i in range(200)]
    rows += [("p", f"c{i}", "z", f"{(i + k) * 37 % 101}") for i in range(90) for k in (0, 1)]
    assert run(spark, rows) == brute(rows)

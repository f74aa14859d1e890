import json
import random

from pyspark.sql import functions as F

from idloom.operators.snapshots import _canonical, assign_ordinals, fingerprints, parse_object, snapshot_changes


def test_canonical_json():
    same = lambda a, b, **k: _canonical(parse_object(a), **k) == _canonical(parse_object(b), **k)
    assert same('{"a": 1.50, "b": [1, 2]}', '{"b":[1e0,2.0],"a":15e-1}')
    assert same('"{\\"a\\": 1}"', '{"a": 1}')
    assert same('{"a": "caf\\u00e9"}', '{"a": "café"}')
    assert not same('{"a": 1}', '{"a": "1"}')
    assert not same('{"a": [1, 2]}', '{"a": [2, 1]}')
    assert same('{"a": [1, 2]}', '{"a": [2, 1]}', unordered=frozenset("a"))
    assert not same('{"a": true}', '{"a": 1}')
    assert same('{"a": 0}', '{"a": -0.0}')
    digits = "0.1234567890123456789012345678901"
    assert not same('{"a": %s1}' % digits, '{"a": %s2}' % digits) and same('{"a": %s1}' % digits, '{"a": %s10}' % digits)
    assert not same('{"a": 1e-2000000}', '{"a": 0}') and same('{"a": 10e2000000}', '{"a": 1e2000001}')
    for bad in (None, "", "{", '{"a": 1', "nope", '{"a": NaN}'):
        assert parse_object(bad) is None


def test_against_brute_force(spark):
    rnd = random.Random(5)
    data, snaps = [], {}
    for g in ("hot", "b", "c"):
        keys = {}
        for t in range(6):
            for k in range(300 if g == "hot" else 5):
                keys.pop(k, None) if rnd.random() < 0.3 else keys.__setitem__(k, rnd.randrange(3)) if rnd.random() < 0.5 else None
            if not keys:
                keys[0] = 1
            snaps[g, t] = dict(keys)
            for k, v in keys.items():
                raw = json.dumps({"org": g, "slug": f"s{k}", "layer": {"v": v, "metrics": rnd.sample([1, 2, 3], 3)} if v else None})
                data += [(g, t, raw)] * rnd.choice([1, 1, 2])
    data += [("x", 0, None), ("x", 1, "{"), ("x", 1, '{"slug": "a"}'), (None, None, '{"org": "b", "slug": "s"}')]
    df = spark.createDataFrame([(i, *d, "clash") for i, d in enumerate(data)], "row_id bigint, g string, t bigint, raw string, org string")
    p = fingerprints(df, "raw", ["org", "slug"], "layer", ["metrics"])
    got = sorted(map(tuple, snapshot_changes(p, "org", "slug", "t", "_print", ["row_id"]).select("org", "slug", "t", "change").collect()))
    want = []
    for g in ("hot", "b", "c"):
        for t in range(1, 6):
            a, b = snaps[g, t - 1], snaps[g, t]
            want += [(g, f"s{k}", t, "added") for k in b.keys() - a.keys()] + [(g, f"s{k}", t, "removed") for k in a.keys() - b.keys()] + [(g, f"s{k}", t, "changed") for k in a.keys() & b.keys() if a[k] != b[k]]
    assert got == sorted(want)


def test_ordinals_persist(spark):
    k = spark.createDataFrame([("a",), ("b",)], "k string")
    first = assign_ordinals(k, ["k"])
    more = assign_ordinals(k.union(spark.createDataFrame([("0",), ("c",)], "k string")), ["k"], first)
    old, new = {r.k: r.ordinal for r in first.collect()}, {r.k: r.ordinal for r in more.collect()}
    assert {x: new[x] for x in old} == old and len(set(new.values())) == 4


def test_empty(spark):
    df = spark.createDataFrame([], "g string, k string, t bigint, c binary")
    assert snapshot_changes(df, "g", "k", "t", "c").count() == 0
    one = spark.createDataFrame([("g", "k", 1, b"x")], "g string, k string, t bigint, c binary")
    assert snapshot_changes(one, "g", "k", "t", "c").select(F.count("*")).first()[0] == 0


def test_any_depth_has_one_spelling():
    import json

    from idloom.operators.snapshots import _deep, canonical, parse_object

    loose = frozenset(["metrics"])
    for t in ('{"metrics":[{"b":1.0,"a":[2,1]},1],"x":{"metrics":[2,1]},"e":[],"o":{}}', "null", "[1,[2,[]]]", '"t"'):
        assert _deep(parse_object(t), loose) == canonical(parse_object(t), loose)
    deep = parse_object('{"a":' + "[" * 50_000 + "1.0" + "]" * 50_000 + "}")
    assert canonical(deep) == '{"a":' + "[" * 50_000 + "n1" + "]" * 50_000 + "}"
    assert canonical(parse_object(json.dumps({"b": 1, "a": 2}))) == canonical(parse_object('{"a":2.0,"b":1e0}'))


def test_ordinals_persist_over_deliveries(spark):
    from idloom.operators.snapshots import delivered_ordinals

    rows = spark.createDataFrame([("g", f"k{i}", f"2023-01-{1 + i // 10:02}") for i in range(60)], "_g string, _k string, t string").selectExpr("_g", "_k", "cast(t as timestamp_ntz) as _t")
    early = {r._k: r.ordinal for r in delivered_ordinals(rows.where("_t < '2023-01-04'"), ["_g", "_k"], None, 1).collect()}
    for parts in (1, 2, 4):
        got = {r._k: r.ordinal for r in delivered_ordinals(rows, ["_g", "_k"], delivered_ordinals(rows.where("_t < '2023-01-04'"), ["_g", "_k"], None, 1), parts).collect()}
        assert len(set(got.values())) == 60 and all(got[k] == o for k, o in early.items())

import datetime
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from idloom.operators.states import entity_states
from idloom.operators.timeline import carry_last

T0 = datetime.datetime(2023, 1, 1)


def test_blocks_carry_as_one_window_would(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), T0 + datetime.timedelta(hours=rnd.randrange(2000)), i, rnd.choice([None, None, "x", "y", "z"]), rnd.choice([None, 1, 2])) for i in range(600)] + [("hot", T0 + datetime.timedelta(hours=i), i, "v" if i % 50 == 0 else None, None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, v string, n int")
    for inclusive, end in ((True, 0), (False, -1)):
        w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, end)
        want = df.select("i", F.last("v", True).over(w).alias("v"), F.last("n", True).over(w).alias("n"), "k", "t")
        got = carry_last(df, ["k"], "t", ["i"], ["v", "n"], inclusive)
        assert sorted(map(str, got.select("i", F.col("_last_v").alias("v"), F.col("_last_n").alias("n"), "k", "t").collect())) == sorted(map(str, want.collect()))
    assert carry_last(df.limit(0), ["k"], "t", ["i"], ["v"]).count() == 0


def test_overlapping_and_plain_states_agree_with_comparing_all(spark):
    rnd = random.Random(5)
    rows = []
    for e in "abcde":
        for n, overlap in (("mode", False), ("plan", True), ("size", False), ("other", True)):
            at = 0
            for i in range(12):
                at += rnd.randrange(1, 9)
                stay = rnd.choice([1, 3, 40, None, 0]) if overlap else rnd.choice([1, 1, None if i == 11 else 1])
                rows.append((f"{e}{n}{i}", e, "person", n, rnd.choice(["u", "v", None]) if n != "size" else None, float(i) if n == "size" else None, T0 + datetime.timedelta(days=at), None if stay is None else T0 + datetime.timedelta(days=at + stay)))
    df = spark.createDataFrame(rows, "state_id string, entity_id string, entity_type string, state_name string, state_value string, state_numeric_value double, state_entered_at timestamp_ntz, state_exited_at timestamp_ntz")
    got = {(r.entity_id, r.valid_from): (r["mode"], r.plan, r.size) for r in entity_states(df, ["mode", "plan"], ["size"]).collect()}
    want = {}
    for e in "abcde":
        mine = [r for r in rows if r[1] == e]
        for t in {x for r in mine for x in r[6:8] if x is not None}:
            held = {}
            for r in sorted(mine, key=lambda r: (r[6], r[0])):
                if (r[4] is not None or r[5] is not None) and r[6] <= t and (r[7] is None or r[7] > t):
                    held[r[3]] = r
            if held:
                want[e, t] = tuple(held[n][k] if n in held else None for n, k in (("mode", 4), ("plan", 4), ("size", 5)))
    assert got == want
    assert entity_states(df.limit(0), ["mode"], []).count() == 0

from idloom.operators.deliveries import merge_ranges, sequence_parts, surplus_rows, take_batches, uncovered

SCHEMA = "row_id bigint, ts timestamp_ntz, key string, ts2 string"


def rows(spark, data):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "row_id bigint, t string, key string, batch string")
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz"))


def brute(data):
    best = {}
    for r, t, k, _ in data:
        if k is not None:
            best[k] = max(best.get(k, ((False, ""), -1)), ((t is not None, t or ""), r))
    return sorted(r for r, t, k, _ in data if k is not None and best[k][1] != r)


def test_ties_nulls_and_repeated_keys(spark):
    data = [
        (1, "2023-01-01", "1000000000000001", "x"), (2, "2023-01-03", "1000000000000001", "x"), (3, "2023-01-03", "1000000000000001", None), (4, None, "1000000000000001", "x"),
        (5, None, "1000000000000002", "x"), (6, None, "1000000000000002", "x"), (7, "2023-01-02", "abc", "x"), (8, "2023-01-02", "abc", "x"), (9, "2023-01-01", "abc", "x"),
        (10, "2023-01-01", None, "x"), (11, None, None, "x"), (12, "2023-01-01", "0000000000000001", "x"), (13, "2023-01-05", "1000000000065536", "x"), (14, "2023-01-04", "1000000000065535", "x"),
    ]
    for batches in (1, 2, 3, 5):
        got = sorted(r[0] for r in surplus_rows(rows(spark, data), "row_id", "key", "ts", batches).collect())
        assert got == brute(data), batches


def test_ranges_merge_and_cover(spark):
    r = spark.createDataFrame([("p", 0, 1, 3), ("p", 0, 4, 4), ("p", 0, 6, 9), ("p", 0, 7, 8), ("q", 0, 2, 2)], "producer string, chunk bigint, lo bigint, hi bigint")
    m = merge_ranges(r)
    assert sorted(map(tuple, m.collect())) == [("p", 0, 1, 4), ("p", 0, 6, 9), ("q", 0, 2, 2)]
    n = spark.createDataFrame([("p", 0, x, f"k{x}") for x in range(0, 12)], "producer string, chunk bigint, number bigint, key string")
    assert sorted(r.number for r in uncovered(n, m).collect()) == [0, 5, 10, 11]


def test_seen_ranges_are_disjoint(spark):
    data = [(i, f"2023-01-0{1 + i % 5}", f"{(0x1000 << 48) + i // 2:016x}", "b") for i in range(60)]
    d = take_batches(rows(spark, data), "row_id", "key", "ts")
    assert [tuple(r) for r in d.ranges.collect()] == [("x1000", 0, 0, 29)]
    data = [(i, f"2023-01-0{1 + i % 5}", str(10**17 + i // 2), "b") for i in range(60)]
    d = take_batches(rows(spark, data), "row_id", "key", "ts")
    assert [tuple(r) for r in d.ranges.collect()] == [("d100000000", 0, 0, 29)]


def test_identifiers_of_both_spellings(spark):
    keys = ["00000000000000ff", "ffffffffffffffff", "FFFFFFFFFFFFFFFF", "1000000000", "999999999", "1" * 30, "1" * 31, "1234567890123456", "12345678901234567", "abc", "g" * 16]
    got = {r.k: (r.p, r.n) for r in (lambda d: d.select("k", *[c.alias(a) for c, a in zip(sequence_parts(d.k), "pn", strict=True)]))(spark.createDataFrame([(k,) for k in keys], "k string")).collect()}
    assert got["00000000000000ff"] == ("x0000", 255) and got["ffffffffffffffff"] == ("xffff", 2**48 - 1) and got["1000000000"] == ("d1", 0)
    assert got["1" * 30] == ("d" + "1" * 21, 111111111) and got["1234567890123456"] == ("x1234", int("567890123456", 16)) and got["12345678901234567"] == ("d12345678", 901234567)
    assert [k for k in keys if got[k] == (None, None)] == ["FFFFFFFFFFFFFFFF", "999999999", "1" * 31, "abc", "g" * 16]
    data = [(i, f"2023-01-0{1 + i % 7}", keys[i % len(keys)], "b") for i in range(90)]
    for batches in (1, 3):
        assert sorted(r[0] for r in surplus_rows(rows(spark, data), "row_id", "key", "ts", batches).collect()) == brute(data)


def test_empty(spark):
    assert surplus_rows(rows(spark, []), "row_id", "key", "ts").count() == 0

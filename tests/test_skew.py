from pyspark.sql import functions as F

from idloom.operators.graph import propagate
from idloom.operators.skew import join_even, join_label


def test_hot_keys_join_in_parts(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 340, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id").unionByName(spark.createDataFrame([(None, 1)], "k string, id bigint"))
    labels = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("label", F.upper("k"))
    want = sorted(map(tuple, rows.join(labels.drop("n"), "k", "left").select("k", "id", "label").collect()), key=str)
    for got in (join_label(rows, labels, "k", "n", "id", hot_rows=50), join_even(rows, labels.drop("n"), "k", "id", hot_rows=50), join_even(rows, labels.drop("n"), "k", "id", hot_rows=5000)):
        assert sorted(map(tuple, got.select("k", "id", "label").collect()), key=str) == want


def test_no_part_holds_a_hot_key(spark):
    """A key with a third of the rows is spread: no task gets over twice the median of the join's rows."""
    from idloom.operators import skew

    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    labels = rows.groupBy("k").agg(F.count("*").alias("n"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        got = skew.join_label(rows, labels, "k", "n", "id", hot_rows=200).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    sizes = sorted(r["count"] for r in got)
    assert sum(sizes) == 60_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_labels_spread_over_hot_links(spark, monkeypatch):
    monkeypatch.setattr(join_even, "__defaults__", (20, None))
    links = [(f"n{i:03}", "hub") for i in range(100)] + [(f"n{i:03}", f"l{i}") for i in range(100)] + [(f"m{i:03}", f"l{i}") for i in range(100)] + [("z", "own")]
    df = spark.createDataFrame(links, "node string, link string")
    got = {r.node: r.label for r in propagate(df.select("node").distinct(), df, None).collect()}
    assert got == {n: "z" if n == "z" else "m000" for n, _ in links}

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from idloom.operators.packed import explode_packed, split_addresses, split_values


def run(spark, texts, f):
    df = spark.createDataFrame([(i, t, "p", "v") for i, t in enumerate(texts)], "id int, text string, pos string, value string")
    got = {}
    for r in explode_packed(df, f(F.col("text"))).collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    return [[v for _, v in sorted(got.get(i, []))] for i in range(len(texts))]


def test_tags(spark):
    texts = ['a, "b, c";d|"e ""f"" g"\t h ', None, "", ";;,", '"open, quote', "x\x01y,\x02z,\x010\x02", '"q,\x01",w', 'one,one', '""', "a" * 100_000 + "," + '"' + "b," * 50_000 + '"']
    want = [["a", "b, c", "d", 'e "f" g', "h"], [], [], [], ['"open', "quote"], ["x\x01y", "\x02z", "\x010\x02"], ["q,\x01", "w"], ["one", "one"], [], ["a" * 100_000, "b," * 50_000]]
    assert run(spark, texts, split_values) == want


def test_addresses(spark):
    texts = [
        '"Desk, North": "A \\"B\\" C" <A@x.test>, d@e.test (Mr, was f@g.test); <H@I.test>;', "Last, First <one@x.test>", "undisclosed-recipients:;", None, "old@a.test <new@b.test>",
        '<a@x.test>\n"B, C" <b@x.test>,\r\n\tc@x.test', "Team: a@x.test, b@x.test;", '<a@x.test> "N" <b@x.test>', "-, (none), <>", '"x@y.test" <z@y.test>', "o'brien+l@x.test",
    ]
    want = [["a@x.test", "d@e.test", "h@i.test"], ["one@x.test"], [], [], ["new@b.test"], ["a@x.test", "b@x.test", "c@x.test"], ["a@x.test", "b@x.test"], ["a@x.test", "b@x.test"], [], ["z@y.test"], ["o'brien+l@x.test"]]
    assert run(spark, texts, split_addresses) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",; \x01\x02', max_size=6), max_size=5), min_size=1, max_size=20))
def test_round_trip(spark, lists):
    texts = [",".join('"' + v.replace('"', '""') + '"' for v in values) for values in lists]
    assert run(spark, texts, split_values) == [[v for v in values if v] for values in lists]


def test_comments_of_several_levels_hold_no_address(spark):
    deep = "(a (b (c x@y.test (d (e z@y.test) f@y.test)) w@y.test))"
    df = spark.createDataFrame([(f"Ann {deep} <ann@x.test>, bob@x.test {deep}, (only a@b.test)",)], "t string")
    assert df.select(split_addresses(df.t).alias("a")).first().a == ["ann@x.test", "bob@x.test"]

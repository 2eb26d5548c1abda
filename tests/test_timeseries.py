import pytest
from pyspark.sql import functions as F

from gristmill import plans
from gristmill import queries
from gristmill.functions.strings import as_text, contains_many, endswith_many, startswith_many
from gristmill.operators import timeseries as ts

NAN = float("nan")


def column(spark, values, make, kind="double"):
    """The expression over values in their order; the rows are dealt out, with another series beside."""
    rows = [(s, k, v) for s in (0, 1) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"s int, o int, a {kind}").repartition(3)
    out = {s: [r.x for r in df.select("s", "o", make(ts.ordered("s", "o")).alias("x")).where(f"s = {s}").orderBy("o").collect()] for s in (0, 1)}
    assert out[0] == out[1]
    return out[0]


def flags(text):
    return [c == "T" for c in text]


def test_value_changed(spark):
    v = [40.0, 44.0, 61.0, None, 66.0, 65.0, 90.0, 81.0]
    for values in (v, [NAN if x is None else x for x in v]):
        assert column(spark, values, lambda w: ts.value_changed("a", w, 10)) == flags("TFTTTFTF")
        assert column(spark, values, lambda w: ts.value_changed("a", w, 10, change_at_nan=False)) == flags("TFTFFFTF")
    assert column(spark, v, lambda w: ts.value_changed("a", w)) == flags("TTTTTTTT")
    assert column(spark, [0.0, 10.0, 19.9], lambda w: ts.value_changed("a", w, 10)) == flags("TTF")


def test_id_changed(spark):
    v = [6, 6, None, 6, 9, 9, None, 4]
    assert column(spark, v, lambda w: ts.id_changed("a", w), "bigint") == flags("TFTTTFTT")
    assert column(spark, v, lambda w: ts.id_changed("a", w, change_at_nan=False), "bigint") == flags("TFFFTFFT")
    assert column(spark, [None, None, "x"], lambda w: ts.id_changed("a", w), "string") == flags("TTT")


def test_grouper(spark):
    b = [7, 7, 5, 5, 5, 5, 5, 7]
    df = spark.createDataFrame([(k, a, x) for k, (a, x) in enumerate(zip([3.0, 4.0, 4.5, 30.0, 31.0, 50.0, 51.0, 52.0], b))], "o int, a double, b bigint")
    w = ts.ordered([], "o")
    assert [r.g for r in df.select("o", ts.grouper(ts.id_changed("b", w) | ts.value_changed("a", w, 10), w).alias("g")).orderBy("o").collect()] == [1, 1, 2, 3, 3, 4, 4, 5]
    assert [r.g for r in df.select("o", ts.grouper(F.col("o") > 5, w, 10).alias("g")).orderBy("o").collect()] == [9] * 6 + [10, 11]


def test_group_row_number(spark):
    a = [5.0, None, 5.0, 8.0, 5.0, None, 8.0, 2.0]
    df = spark.createDataFrame(list(enumerate(a)), "o int, a double").repartition(3)
    out = df.select("o", ts.group_row_number("a", "o").alias("up"), ts.group_row_number("a", "o", ascending=False).alias("down")).orderBy("o").collect()
    assert [r.up for r in out] == [0, 0, 1, 0, 2, 1, 1, 0] and [r.down for r in out] == [2, 1, 1, 1, 0, 0, 0, 0]


N = None


@pytest.mark.parametrize(
    "values, limit, want",
    [
        ([31, N, 35, N, N, 38, N, N, N, N, 42, N, N, N, 50], None, [31, 31, 35, 35, 38, 38, 38, 38, 42, 42, 42, 42, 42, 50, 50]),
        ([N, N, 5, N, N], None, [N, 5, 5, 5, N]),
        ([1, N, N, N, N, N, 2], 1, [1, 1, N, N, N, 2, 2]),
        ([N, N], None, [N, N]),
    ],
)
def test_fbfill(spark, values, limit, want):
    assert column(spark, values, lambda w: ts.fbfill("a", w, limit), "bigint") == want


def test_one_shuffle(spark):
    df = queries.sessionize(spark, "/root/testdata/sf0.001")
    counts = plans.nodes(df)
    assert counts["Exchange"] == 1 and not [n for n in counts if "Join" in n], counts


def test_strings(spark):
    df = spark.createDataFrame([(k, a) for k, a in enumerate(["maple", "plane", "nettle", "lemon", None])], "o int, a string")
    of = lambda c: [r[1] for r in df.select("o", c).orderBy("o").collect()]
    a = F.col("a")
    assert of(startswith_many(a, ["ma", "pla"])) == flags("TTFFF") and of(endswith_many(a, ["tle", "mon"])) == flags("FFTTF")
    assert of(contains_many(a, ["map", "mon"])) == flags("TFFTF") and of(contains_many(a, ["^.l", "n$"])) == flags("FTFTF")
    assert of(contains_many(a, ["^.l"], regex=False)) == flags("FFFFF") and of(startswith_many(a, [])) == flags("FFFFF")


def test_text_of_numbers(spark):
    values = [1.0, 2.0, 4.01, 100.0, 1e7, 123456789.5, 0.0001, 0.00012345, 1e-5, 1e15, 1e16, 1.5e16, -2.5e300, 1.5e-7, 1e-320, 0.0, -0.0, 0.1, 1 / 3, float("inf"), -float("inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*values, None, NAN])], "o int, a double")
    of = lambda **k: [r.x for r in df.select("o", as_text(F.col("a"), "double", **k).alias("x")).orderBy("o").collect()]
    assert of() == [str(v) for v in values] + [None, None]
    assert of(remove_dotzero=True) == [str(v).removesuffix(".0") for v in values] + [None, None]
    assert of(keep_nan=False) == [str(v) for v in values] + ["nan", "nan"]
    more = spark.createDataFrame([(1, True, "10.0"), (None, None, None)], "i int, b boolean, s string")
    assert [tuple(r) for r in more.select(as_text(F.col("i"), "int"), as_text(F.col("b"), "boolean"), as_text(F.col("s"), "string", remove_dotzero=True)).collect()] == [("1", "True", "10"), (None, None, None)]

import pandas as pd
import pytest

from gristmill.functions.schema import make_schema
from gristmill.operators import partitions, reshape

from test_aggregate import got


def test_list_column(spark):
    df = spark.createDataFrame([(5, 8, ["40", "41"]), (6, 9, ["7"]), (7, 8, ["9", "9", "-3"]), (8, 4, []), (9, 5, None)], ["idx", "b", "a-list"])
    out = reshape.stack_list_column(df, "a-list", "int", ["b"], "idx")
    assert out.columns == ["idx", "b", "a-list"]
    assert got(out) == sorted([(5, 8, 40), (5, 8, 41), (6, 9, 7), (7, 8, 9), (7, 8, 9), (7, 8, -3)], key=str)


def test_list_columns(spark):
    df = spark.createDataFrame([(5, 8, ["40", "41"], ["oak", "elm"]), (6, 9, ["7", "8", "9"], ["fir"]), (7, 8, None, ["yew"])], "idx int, b int, `a1-list` array<string>, `a2-list` array<string>")
    out = reshape.stack_list_columns(df, ["a1-list", "a2-list"], ["string", "str"], ["b"], "idx")
    assert out.columns == ["idx", "b", "a1-list", "a2-list"]
    assert got(out) == sorted([(5, 8, "40", "oak"), (5, 8, "41", "elm"), (6, 9, "7", "fir"), (6, 9, "8", None), (6, 9, "9", None), (7, 8, None, "yew")], key=str)


def test_dict_column(spark):
    df = spark.createDataFrame([(5, {"oak": 12}, 8), (6, {"elm": 7, "fir": None}, 9), (7, {}, 4), (8, None, 4)], "idx int, a map<string,bigint>, b int")
    out = reshape.stack_dict_column(df, "a", "string", "bigint", ["b"], "idx")
    assert out.columns == ["idx", "b", "a_value", "a_label"]
    assert got(out) == sorted([(5, 8, 12, "oak"), (6, 9, 7, "elm"), (6, 9, None, "fir")], key=str)


WIDE = [(31, 7, 70, 12, "oak"), (32, 8, 80, 15, "elm"), (33, 9, 90, 18, "fir")]


def test_stack_and_unstack(spark):
    df = spark.createDataFrame(WIDE, "idx bigint, a bigint, b bigint, c bigint, label string")
    long = reshape.stack_columns(df, ["a", "b"], ["label"], "idx")
    assert long.columns == ["idx", "label", "stack_label", "stacked"]
    assert got(long) == sorted([(i, s, k, v) for i, a, b, _, s in WIDE for k, v in (("a", a), ("b", b))], key=str)
    mixed = df.selectExpr("idx", "if(idx = 31, null, a) a", "if(idx = 32, double('nan'), b) b", "label s")
    assert got(reshape.stack_columns(mixed, ["a", "b"], [], "idx"), "idx", "stacked") == sorted([(31, 70.0), (32, 8.0), (33, 9.0), (33, 90.0)], key=str)
    assert dict(reshape.stack_columns(mixed, ["a", "s"], [], "idx").dtypes)["stacked"] == "string"
    wide = reshape.unstack_column(df, ["a", "b"], ["label"], "c")
    assert wide.columns == ["label", "7_70c", "8_80c", "9_90c"]
    assert got(wide) == [("elm", None, 15, None), ("fir", None, None, 18), ("oak", 12, None, None)]
    named = reshape.unstack_column(df.selectExpr("if(a = 9, null, a) a", "b", "c", "label"), ["a", "b"], ["label"], "c", "-", "!")
    assert "null-90!" in named.columns
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="more than 2"):
            reshape.unstack_column(df, ["a"], ["label"], "c")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    with pytest.raises(ValueError):
        reshape.unstack_column(df.union(df), ["a"], ["label"], "c")


def test_schema():
    kind = make_schema(("idx", "object"), [("int_value", "int"), ("str_value", object), ("float_value", "float"), ("t", "datetime64[ns]"), ("l", "array<int>")])
    assert kind.simpleString() == "struct<idx:string,int_value:bigint,str_value:string,float_value:double,t:timestamp_ntz,l:array<int>>"
    assert make_schema((None, "int"), [("a", bool)]).simpleString() == "struct<a:boolean>"


def test_partitions(spark):
    df = spark.createDataFrame([(k, k, k + 100) for k in range(100)], "idx bigint, a bigint, b bigint").repartition(4)
    out = partitions.map_partitions(df, lambda f, v: pd.DataFrame({"more": 1, "b": f.b * v, "idx": f.idx}), "idx bigint, b bigint", v=100)
    assert out.columns == ["idx", "b"] and got(out) == sorted([(k, 100 * (k + 100)) for k in range(100)], key=str)
    whole = partitions.map_partitions(df, lambda f: pd.DataFrame({"n": [len(f)]}), "n bigint", whole_partition=True)
    assert sum(r.n for r in whole.collect()) == 100 and whole.count() == 4
    three = lambda r: [{"value": r["a"] + j, "support": r["b"]} for j in range(3)]
    want = sorted([(k, k + j, k + 100) for k in range(100) for j in range(3)], key=str)
    assert got(partitions.flat_map_records(df, three, [("value", "int"), ("support", "int")], "idx")) == want
    assert got(partitions.flat_map_frames(df, lambda r: pd.DataFrame(three(r), index=[7, 8, 9]), "value bigint, support bigint", "idx")) == want
    records = df.selectExpr("idx", "array(struct(a as value, b as support), struct(a + 1 as value, b as support), struct(a + 2 as value, b as support)) r")
    assert got(partitions.inline_records(records, "r", "idx")) == want
    assert partitions.flat_map_records(df.limit(0), three, "value bigint, support bigint", "idx").count() == 0

import pandas as pd
import pytest

from gristmill import plans
from gristmill.operators import joins

from test_aggregate import got

#: Key pairs, each once, and a word for each on either side.
PAIRS = [(x, y) for x in (11, 12, 13) for y in (21, 22, 23, 24)]
WORDS = [f"{'ash beech cedar'.split()[x - 11]} {y}" for x, y in PAIRS]


@pytest.fixture
def sides(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    left = spark.createDataFrame([(*p, w) for p, w in zip(PAIRS, WORDS)], "A bigint, B bigint, C string").repartition(3)
    right = spark.createDataFrame([(*p, w.upper()) for p, w in zip(PAIRS, WORDS)], "a bigint, b bigint, c string").repartition(2)
    yield left, right
    spark.conf.unset("spark.sql.caseSensitive")


def test_index_stays(sides):
    left, right = sides
    out = joins.merge_keep_index(left, right, ["A", "B"], ["a", "b"], "inner", left_index="A", right_index="a")
    assert out.columns == ["A", "B", "C", "a", "b", "c"]
    assert got(out) == sorted([(*p, w, *p, w.upper()) for p, w in zip(PAIRS, WORDS)], key=str)
    other = joins.merge_keep_index(left, right, ["A", "B"], ["a", "b"], "inner", left_index=["A", "B"], right_index=["a", "b"], reindex_by_left=False, reindex_by_right=True)
    assert other.columns == ["a", "b", "A", "B", "C", "c"] and other.count() == 12


def test_preconditions(sides):
    left, right = sides
    call = lambda **k: joins.merge_keep_index(left, right, "A", "a", **{"left_index": "A", "right_index": "a", **k})
    for wrong in ({"reindex_by_right": True}, {"left_index": "C", "right_index": "C"}, {"left_index": ()}, {"right_index": ()}, {"how": "cross"}, {"reindex_by_left": False}):
        with pytest.raises(ValueError):
            call(**wrong)


def test_nulls_suffixes_and_hows(spark):
    nan = float("nan")
    left = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 7.0, "z")], "i int, k double, v string")
    right = spark.createDataFrame([(10, 1.0, "p"), (20, nan, "q"), (30, 9.0, "r")], "j int, k double, v string")
    call = lambda how: joins.merge_keep_index(left, right, "k", "k", how, left_index="i", right_index="j")
    inner = [(1, 1.0, "x", 10, "p"), (2, None, "y", 20, "q")]
    assert call("inner").columns == ["i", "k", "v_x", "j", "v_y"] and got(call("inner")) == sorted(inner, key=str)
    assert got(call("left")) == sorted([*inner, (3, 7.0, "z", None, None)], key=str)
    assert got(call("right")) == sorted([*inner, (None, 9.0, None, 30, "r")], key=str)
    assert got(call("outer")) == sorted([*inner, (3, 7.0, "z", None, None), (None, 9.0, None, 30, "r")], key=str)
    assert "CartesianProduct" not in plans.nodes(call("outer")) and "BroadcastNestedLoopJoin" not in plans.nodes(call("outer"))


def test_broadcast(spark, monkeypatch):
    left = spark.range(100).selectExpr("id", "id % 3 as k").repartition(4)
    right = pd.DataFrame({"j": [7, 8, 9], "kk": [0, 1, 5]})
    for form in (right, lambda: right, spark.range(7, 10).selectExpr("id as j", "id - 7 as kk")):
        out = joins.merge_broadcast(left, form, "k", "kk", "left", left_index="id", right_index="j")
        assert out.count() == 100 and "BroadcastHashJoin" in plans.nodes(out)
    full = joins.merge_broadcast(left, right, "k", "kk", "outer", left_index="id", right_index="j")
    assert full.where("id is null").count() == 1
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    large = joins.merge_broadcast(left, right, "k", "kk", "left", left_index="id", right_index="j")
    assert large.count() == 100 and "SortMergeJoin" in plans.nodes(large)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

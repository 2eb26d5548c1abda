import pytest
from pyspark.sql import functions as F

from gristmill.functions.nulls import is_in, without_nan
from gristmill.operators import aggregate as A
from gristmill.operators import filters
from gristmill.plans import nodes

#: a, b, key
ROWS = [(4, 7, 1), (9, 20, 3), (4, 11, 1), (6, 2, 3), (9, 31, 3), (8, 5, 5), (6, 40, 1)]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "a bigint, b bigint, key bigint").repartition(3)


def test_flat_names(rows):
    out = A.aggregate_flat(rows, "key", {"a": ["sum", "min"], "b": ["mean", "sum", "max"]})
    assert out.columns == ["key", "a_sum", "a_min", "b_mean", "b_sum", "b_max"]
    assert got(out) == [(1, 14, 4, 58 / 3, 58, 40), (3, 24, 6, 53 / 3, 53, 31), (5, 8, 8, 5.0, 5, 5)]


def test_index_and_keys(rows):
    out = A.aggregate_by_index_and_keys(rows, "key", ["a"], {"b": ["mean", "max"]})
    assert got(out) == sorted([(1, 4, 9.0, 11), (1, 6, 40.0, 40), (3, 9, 25.5, 31), (3, 6, 2.0, 2), (5, 8, 5.0, 5)], key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_aggregate_beside_rows(spark, partitions):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "o int, a bigint, b bigint, key bigint").repartition(partitions)
    out = A.aggregate_as_column_by_index_and_keys(df, "key", ["a"], "b", "sum", "sum_b")
    assert [r.sum_b for r in out.orderBy("o").collect()] == [18, 51, 18, 2, 51, 5, 40]


def test_null_rules(spark):
    nan = float("nan")
    df = spark.createDataFrame([("x", 1.0, 1), ("x", nan, 2), (None, 5.0, 3), ("y", None, 4), ("y", nan, 5)], "k string, v double, o int")
    out = A.aggregate_flat(df, "k", {"v": ["sum", "mean", "count", "size", "first", "nunique", "prod"]}, order_by=["o"])
    assert got(out) == [("x", 1.0, 1.0, 1, 2, 1.0, 1, 1.0), ("y", 0.0, None, 0, 2, None, 0, 1.0)]
    beside = A.aggregate_as_column(df, "k", "v", "sum", "s")
    assert [r.s for r in beside.orderBy("o").collect()] == [1.0, 1.0, None, 0.0, 0.0]
    assert A.aggregate_as_column(df, "k", "v", "nunique", "s", null_keys="drop").orderBy("o").select("s").toPandas().s.tolist() == [1, 1, 0, 0]
    assert [r.v for r in without_nan(df).orderBy("o").collect()] == [1.0, None, 5.0, None, None]
    assert [r[0] for r in df.orderBy("o").select(is_in(F.col("k"), ["x", None])).collect()] == [True, True, True, False, False]


def test_every_function_and_callable(spark):
    df = spark.createDataFrame([(1, 1.0, True), (1, 2.0, False), (1, 4.0, None)], "k int, v double, f boolean")
    out = A.aggregate_flat(df, "k", {"v": ["std", "var", "median", "quantile", "min", "max", "prod"], "f": ["any", "all"]}).first()
    assert out.v_var == pytest.approx(7 / 3) and out.v_std == pytest.approx((7 / 3) ** 0.5) and (out.v_median, out.v_quantile, out.v_prod, out.f_any, out.f_all) == (2.0, 2.0, 8.0, True, False)

    def spread(values):
        return values.max() - values.min()

    assert A.aggregate_flat(df, "k", {"v": [spread]}).first().v_spread == 3.0
    with pytest.raises(ValueError):
        A.aggregate_flat(df, "k", {"v": ["first"]})
    with pytest.raises(ValueError):
        A.aggregate_flat(df, "k", {"v": "mode"})


def test_drop_rows(spark, monkeypatch):
    df = spark.createDataFrame([(k, 10 * k) for k in range(6)] + [(None, 7)], "i bigint, a bigint")
    for inline in (1000, 0):
        monkeypatch.setattr(filters, "INLINE", inline)
        assert got(filters.drop_rows_by_index(df, "i", [0, 2, 3]), "i") == sorted([(1,), (4,), (5,), (None,)], key=str)
        assert got(filters.drop_rows_by_index(df, "i", [0, 2, 3, None]), "i") == [(1,), (4,), (5,)]
        assert filters.drop_rows_by_index(df, "i", []).count() == 7


def test_drop_duplicates(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)] + [(7, None, 1, 5), (8, None, 2, 5), (9, 1, 3, None)], "o int, a bigint, b bigint, key bigint").repartition(4)
    call = lambda **k: got(filters.drop_duplicates_by_index_and_keys(df, "key", ["a"], ["o"], **k), "key", "a", "b")
    assert call() == sorted([(1, 4, 7), (3, 9, 20), (3, 6, 2), (5, 8, 5), (1, 6, 40), (5, None, 1)], key=str)
    assert call(keep="last") == sorted([(1, 4, 11), (3, 9, 31), (3, 6, 2), (5, 8, 5), (1, 6, 40), (5, None, 2)], key=str)
    assert call(keep=False) == sorted([(3, 6, 2), (5, 8, 5), (1, 6, 40)], key=str)
    with pytest.raises(ValueError):
        call(keep="any")


def test_helper_columns_take_no_name_of_the_table(spark, monkeypatch):
    df = spark.createDataFrame([(1, 5, 7, "x"), (1, 5, 8, "y"), (2, 6, 9, "z")], "key int, n int, N_ int, label string")
    for keep, want in (("first", [(1, 5, 7, "x"), (2, 6, 9, "z")]), (False, [(2, 6, 9, "z")])):
        out = filters.drop_duplicates_by_index_and_keys(df, "key", ["n"], ["label"], keep=keep)
        assert out.columns == df.columns and got(out) == want
    monkeypatch.setattr(filters, "INLINE", 0)
    assert got(filters.drop_rows_by_index(df, "label", ["x"])) == [(1, 5, 8, "y"), (2, 6, 9, "z")]


def test_distinct_values_beside_rows(spark):
    rows = [("p", v) for v in (3.0, None, 3.0, 1.0, float("nan"), 2.0)] + [("q", None), ("r", 1.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "o int, k string, v double")
    out = A.aggregate_as_column(df, "k", "v", "nunique", "n")
    assert [r.n for r in out.orderBy("o").collect()] == [3] * 6 + [0, 1] and dict(out.dtypes)["n"] == "bigint"
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_given_names_are_flattened(spark):
    df = spark.sql("select 1 k, struct(2 as sum, 3 as min) a, struct(4 as ``) b, cast(null as struct<x: int>) c")
    out = A.flatten_names(df)
    assert out.columns == ["k", "a_sum", "a_min", "b", "c_x"] and got(out) == [(1, 2, 3, 4, None)]
    assert A.flatten_names(out).columns == out.columns and A.flatten_names(df, ".").columns[1] == "a.sum"


def test_distinct_values_of_files_are_counted_without_sorting_the_rows(spark, tmp_path):
    nan = float("nan")
    rows = [(0.0, "a", 1), (-0.0, "b", 1), (nan, "a", 2), (None, "a", 2), (1.0, None, 2), (1.0, "c", None), (1.0, "c", 1), (1.0, "d", 1), (0.0, "a", 1)]
    spark.createDataFrame(rows, "k double, v string, `n.` int").write.parquet(str(tmp_path / "t"))
    df, given = spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame(rows, "k double, v string, `n.` int").coalesce(1)
    assert A.reads_alike(df) and not A.reads_alike(given)
    for keys in ("k", ["k", "n."], ["n."]):
        for null_keys in ("null", "drop"):
            for output in ("n", "N.", "v", "k", "o.p"):
                a, b = (A.aggregate_as_column(x, keys, "v", "nunique", output, null_keys) for x in (df, given))
                assert a.columns == b.columns and a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    found = nodes(A.aggregate_as_column(df, "k", "v", "nunique", "n"))
    assert found["ShuffledHashJoin"] == 1 and not found["Window"] and not found["Sort"]


def test_groups_that_may_not_fit_are_not_hashed_and_unstable_rows_are_read_once(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id % 7 k", "id % 3 v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(A.aggregate_as_column(df, "k", "v", "nunique", "n").collect())
    assert {r.n for r in want} == {3}
    monkeypatch.setattr(A, "HASHED_BYTES", 0)
    out = A.aggregate_as_column(df, "k", "v", "nunique", "n")
    assert not nodes(out)["ShuffledHashJoin"] and sorted(out.collect()) == want
    for other in (df.withColumn("r", F.rand()), df.dropDuplicates(["v"]), df.limit(9), df.where("k < (select max(id) from range(6))"), df.sample(0.5)):
        assert not A.reads_alike(other) and nodes(A.aggregate_as_column(other, "k", "v", "nunique", "n"))["Window"]

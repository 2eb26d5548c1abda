import json
import threading
import urllib.request
from pathlib import Path

import pytest

from gristmill.sources import catalog as C
from gristmill.sources import charts, layout, object_source, objects, paths, session
from gristmill.sources.digest import digest

from test_aggregate import got

CSV1 = "a,b,c\n7,oak,0.5\n8,elm,2.5\n12,fir,4.0\n15,yew,8.25\n31,ash,16.0\n"


@pytest.fixture
def csvs(spark, tmp_path):
    (tmp_path / "1.csv").write_text(CSV1)
    (tmp_path / "2.csv").write_text("\n".join(x if x[:1] == "a" else x.replace(",", "0,", 1) for x in CSV1.strip().split("\n")))
    return layout.read_csv(spark, tmp_path / "1.csv"), layout.read_csv(spark, tmp_path / "2.csv")


def test_paths():
    u = paths.S3URL("bucket/x")
    assert (u, u / "y", paths.S3URL("s3://b/") / "k" / "l") == ("s3://bucket/x", "s3://bucket/x/y", "s3://b/k/l")
    assert (u.bucket(), (u / "y").key(), u.mkdir(parents=True)) == ("bucket", "x/y", None)
    assert [type(paths.local_or_s3(x)) for x in (Path("a"), u, "a", "s3://a")] == [type(Path("a")), paths.S3URL, type(Path("a")), paths.S3URL]
    assert paths.spark_path(u) == "s3a://bucket/x" and paths.spark_path(Path("a/b")) == "a/b"


def test_digest(spark, csvs):
    one, two = csvs
    assert digest(one) != digest(two) and digest(one.withColumn("a", (one.a * 10).cast("int"))) == digest(two)
    rows = spark.createDataFrame([(k, k * k % 7, "oak elm fir".split()[k % 3]) for k in range(20)], "i long, a long, b string")
    assert digest(rows) == digest(rows.repartition(5)) == digest(rows.orderBy("b", ascending=False))
    assert digest(rows) != digest(rows.union(rows)) != digest(rows.union(rows).union(rows))
    of = lambda sql: digest(spark.sql(sql))
    assert of("select 1 a, null b, 2 c") != of("select 1 a, 2 b, null c") and of("select map('a',1,'b',2) m") == of("select map('b',2,'a',1) m")
    assert of("select 0.0D x") == of("select -0.0D x") and of("select double('nan') x") == of("select double('nan') x") != of("select double(null) x")
    assert of("select struct(1 a, null b) s") != of("select struct(null a, 1 b) s") and digest(rows.limit(0)) != digest(rows)


def test_layout(spark, tmp_path):
    df = spark.createDataFrame([(k, f"0{k % 3}", k * 1.5) for k in range(60)], "i long, code string, v double")
    out = layout.set_index_via_disk(df, "code", tmp_path / "by")
    assert out.columns == ["i", "v", "code"] and dict(out.dtypes)["code"] == "string" and got(out, "i", "code", "v") == got(df)
    assert sorted(p.name for p in (tmp_path / "by").glob("code=*")) == ["code=00", "code=01", "code=02"]
    assert "PartitionFilters: [isnotnull(code" in out.where("code = '01'")._jdf.queryExecution().executedPlan().toString()
    files = list((tmp_path / "by" / "code=01").glob("*.parquet"))
    assert got(layout.read_partition_files(spark, files, "code", "01")) == got(out.where("code = '01'"))
    back, key = layout.persist(df, tmp_path / "kept")
    assert got(back) == got(df) and (tmp_path / "kept" / key).is_dir()
    assert got(layout.sorted_by(df, "v", 3)) == got(df) and layout.sorted_by(df, "v", 3).rdd.getNumPartitions() <= 3


class Box:
    def __init__(self, x):
        self.x = x


def test_objects(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, b string")
    made = df.withColumn("d", objects.object_column(lambda b: None if b is None else {"b": [b]}, "b"))
    assert objects.write_objects(made, tmp_path / "o", ["d"]) == {"object_columns": ["d"], "codec": "json"}
    back = layout.read_parquet(spark, tmp_path / "o")
    assert got(back.select("i", objects.from_objects("d", lambda x: x["b"][0] * 2, "string").alias("x"))) == [(1, "aa"), (2, None)]
    text = objects.encode(Box(3), "pickle")
    assert objects.decode(text, "pickle", trusted=True).x == 3
    with pytest.raises(PermissionError):
        objects.decode(text, "pickle")
    with pytest.raises(PermissionError):
        objects.from_objects("d", str, "string", codec="pickle")
    with pytest.raises(ValueError):
        objects.write_objects(df, tmp_path / "p", ["i"])


def test_versions():
    assert sorted(["1.10", "1.9", "1.a", "2"], key=C.parse_version) == ["1.9", "1.10", "1.a", "2"]
    assert C.version_and_name("a_b_1.0") == ("1.0", "a_b") and C.version_name("a", "1") == "a_1"
    for bad in (lambda: C.version_and_name("a"), lambda: C.Source("a b", "1"), lambda: C.Source("a", "1_0"), lambda: C.validate_version("")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("suffix", ["json", "yaml"])
def test_catalog_and_lineage(spark, tmp_path, csvs, suffix):
    if suffix == "yaml":
        pytest.importorskip("yaml")
    one, two = csvs
    cat = C.Catalog(tmp_path / "m" / f"catalog.{suffix}", spark)
    a = cat.publish(one, "a", "1.9", tmp_path)
    cat.publish(two, "a", "1.10", tmp_path)
    assert a.digest == digest(one) and cat["a"].version == "1.10" and cat["a_1.9"] == a == cat[a] == cat.find_version("a", "1.9")
    times = cat.analysis("b", "1", ["a_1.9"], tmp_path)(lambda a: a.withColumn("a", (a.a * 10).cast("int")))
    b = times()
    assert b.digest == digest(two) and b.upstream == (("a_1.9", a.digest),)
    c = cat.analysis("c", "1", ["b", "a_1.10"], tmp_path)(lambda b, a: b.union(a))()
    well, state = cat.validate()
    assert well and state["c_1"] == [("b_1", True), ("a_1.10", True), ("c_1", True)] and cat.validate(deep=True)[0]
    assert C.Catalog(cat.file, spark)["c"] == c and "c_1" in cat and set(cat) == {"a_1.9", "a_1.10", "b_1", "c_1"}
    with pytest.raises(KeyError):
        cat["nothing"]
    with pytest.raises(C.LineageError):
        cat.find("a_1.9", "0" * 32)
    cat.publish(two.limit(3), "a", "1.9", tmp_path)
    well, state = cat.validate()
    assert not well and state["b_1"] == [("a_1.9", False), ("b_1", False)] and state["c_1"][0] == ("b_1", False)
    with pytest.raises(C.LineageError):
        cat["c"]
    del cat.records["a_1.10"]
    assert cat.validate()[1]["c_1"][1] == ("a_1.10", False)
    copy = b.export(spark, tmp_path / "copy")
    assert copy.metadata["exported_from"] == b.path and copy.read(spark).count() == 5


def test_dump(spark, tmp_path, csvs):
    cat = C.Catalog(tmp_path / "c.json", spark)
    source, job = cat.dump(csvs[0], "later", tmp_path, compute=False)
    assert "later" not in cat and not (tmp_path / "later").exists()
    assert job() == source and cat["later"].read(spark).count() == 5
    pandas_source, _ = cat.dump_pandas(csvs[1].toPandas(), "frame", tmp_path, partitions=2)
    assert pandas_source.read(spark).count() == 5 and json.loads((tmp_path / "c.json").read_text())["sources"].keys() == {"later", "frame"}
    assert cat.publish_pandas(csvs[1].toPandas(), "v", "1", tmp_path).digest and not list(tmp_path.glob(".c.json*"))


class Shell:
    def __init__(self):
        self.user_ns, self.magics = {}, {}

    def register_magic_function(self, f, kind, name):
        self.magics[name] = f


def test_session_and_charts(spark, tmp_path, csvs, capsys):
    cat = C.Catalog(tmp_path / "c.json", spark)
    cat.publish(csvs[0], "a", "1", tmp_path)
    s, store, shell = session.AnalysisSession(cat, tmp_path), charts.ChartStore(tmp_path / "charts"), Shell()
    session.load_magics(shell, s, store)
    with pytest.raises(RuntimeError):
        s.end(csvs[0])
    shell.magics["begin_analysis"]("double 1.0")
    shell.magics["add_analysis_upstream"]("a")
    shell.user_ns["out"] = shell.user_ns["a"].selectExpr("a * 2 as a")
    assert shell.magics["end_analysis"]("out").upstream[0][0] == "a_1"
    shell.magics["validate_catalog"]("")
    assert "catalog valid" in capsys.readouterr().out
    shell.user_ns["fig"] = "<b>chart</b>"
    shell.magics["serve_chart"]("fig")
    with pytest.raises(ValueError):
        store["../x"] = "no"
    server = charts.serve(charts.ChartStore(tmp_path / "charts"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/charts/"
    assert urllib.request.urlopen(url + "fig").read() == b"<b>chart</b>"
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(url + "none")
    server.shutdown()


def test_persist_roundtrip_keeps_the_whole_table(spark, tmp_path, monkeypatch):
    from gristmill import queries

    monkeypatch.setattr(queries, "scratch", lambda spark: str(tmp_path / "kept"))
    sf = "/root/testdata/sf0.001"
    got = queries.persist_roundtrip(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    kept = spark.read.parquet(str(next((tmp_path / "kept").iterdir())))
    assert sorted(kept.collect()) == sorted(orders.collect())
    assert sorted(got.collect()) == sorted(orders.collect())


def test_manifest_in_a_shared_store(spark, tmp_path, csvs):
    """A catalog whose file is named by a URL is read and written by Spark's own file systems."""
    root = paths.local_or_s3(f"file://{tmp_path}")
    assert type(root) is paths.URL and (root / "x").suffix == "" and (root / "c.json").suffix == ".json"
    cat = C.Catalog(root / "m" / "catalog.json", spark)
    a = cat.publish(csvs[0], "a", "1", root)
    cat.publish(csvs[1], "a", "2", root, [a])
    again = C.Catalog(f"file://{tmp_path}/m/catalog.json", spark)
    assert again["a"].upstream == (("a_1", a.digest),) and again.validate(deep=True)[0] and json.loads((tmp_path / "m" / "catalog.json").read_text())["sources"].keys() == {"a_1", "a_2"}
    assert not list((tmp_path / "m").glob("*.new"))


def test_object_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, b string").withColumn("d", objects.object_column(lambda b: None if b is None else {"b": {b}}, "b", codec="pickle"))
    cat = C.Catalog(tmp_path / "c.json", spark)
    source = object_source.publish_objects(cat, df, "o", "1", tmp_path, ["d"], "pickle")
    decoders = {"d": (lambda x: sorted(x["b"])[0] * 2, "string")}
    assert got(object_source.read_objects(cat["o"], spark, decoders, trusted=True), "i", "d") == [(1, "aa"), (2, None)]
    assert got(object_source.read_objects(cat["o"], spark, {}), "i") == [(1,), (2,)]
    for wrong in (lambda: object_source.read_objects(source, spark, {"b": decoders["d"]}), lambda: object_source.publish_objects(cat, df, "p", "1", tmp_path, ["i"]), lambda: object_source.read_objects(cat.publish(df, "q", "1", tmp_path), spark, {})):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(PermissionError):
        object_source.read_objects(source, spark, decoders)
    kept = object_source.persist_objects(source, spark, tmp_path / "kept", ttl=60)
    assert kept.path != source.path and kept.metadata["exported_from"] == source.path and got(object_source.read_objects(kept, spark, decoders, True), "d") == [("aa",), (None,)]
    now = kept.metadata["exported_at"]
    assert not object_source.expired(kept, now + 59) and object_source.expired(kept, now + 60) and not object_source.expired(source)


def test_notebook_starts_a_project(spark, tmp_path, csvs, capsys):
    shell, s = Shell(), session.AnalysisSession()
    session.load_magics(shell, s)
    with pytest.raises(RuntimeError):
        shell.magics["begin_analysis"]("x 1")
    shell.magics["start_nb"](f"trees {tmp_path}/c.json {tmp_path}/tables")
    assert "trees" in capsys.readouterr().out and s.project == "trees"
    s.catalog.publish(csvs[0], "a", "1", tmp_path)
    shell.magics["begin_analysis"]("x 1 a")
    shell.user_ns["out"] = shell.user_ns["a"].limit(2)
    assert shell.magics["end_analysis"]("out").path == str(tmp_path / "tables" / "x" / "1")

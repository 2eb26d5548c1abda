"""A query for each operator over the tables of a folder, and DuckDB SQL for the same rows."""

from __future__ import annotations

import contextlib
import io
import tempfile
import threading
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.strings import as_text, contains_many, endswith_many, startswith_many
from .operators import aggregate as A
from .operators import filters, joins, partitions, reshape
from .operators import timeseries as ts
from .functions import schema as schemas
from .sources import digest as digests
from .sources import layout, objects
from .sources import object_source as object_sources
from .sources.catalog import Catalog, LineageError, Source
from .sources.charts import ChartStore, serve
from .sources.paths import S3URL, local_or_s3, spark_path
from .sources.session import AnalysisSession, load_magics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder where the cluster shares files, deleted when the application ends; a local one only where none is set and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gristmill-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def cents(c: str):
    return F.col(c).cast("decimal(18,2)")


HOLES = "CASE WHEN event_id % 5 <> 0 THEN value END"
EVENTS = "w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with every fifth value missing."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))


@query("""
WITH flagged AS (
  SELECT *, NOT coalesce(abs(epoch(ts) - lag(epoch(ts)) OVER w) < 21600, false) OR coalesce(event_type <> lag(event_type) OVER w, true) AS flag FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), grouped AS (
  SELECT *, CAST(sum(CAST(flag AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_id FROM flagged
)
SELECT event_id, user_id, session_id, CAST(row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) - 1 AS BIGINT) AS place,
  CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id, session_id) AS DOUBLE) AS session_value FROM grouped
""")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of type or gaps of six hours start a session; rows are numbered, and the session's value stands in each. One shuffle in all."""
    w = ts.ordered("user_id", ["ts", "event_id"])
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", cents("value").alias("v"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    flags = ts.value_changed(seconds, w, 21600) | ts.id_changed("event_type", w)
    grouped = e.withColumn("session_id", ts.grouper(flags, w))
    numbered = grouped.withColumn("place", ts.group_row_number(["user_id", "session_id"], ["ts", "event_id"]))
    total = A.aggregate_as_column(numbered, ["user_id", "session_id"], "v", "sum", "total")
    return total.select("event_id", "user_id", "session_id", "place", F.col("total").cast("double").alias("session_value"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty_sum, CAST(min(l_quantity) AS DOUBLE) AS qty_min,
  max(l_shipdate) AS l_shipdate_max, CAST(count(l_tax) AS BIGINT) AS l_tax_count, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS l_suppkey_nunique FROM lineitem GROUP BY ALL""")
def aggregate_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("qty", cents("l_quantity"))
    out = A.aggregate_flat(df, ["l_returnflag", "l_linestatus"], {"qty": ["sum", "min"], "l_shipdate": ["max"], "l_tax": ["count"], "l_suppkey": ["nunique"]})
    return out.withColumns({c: F.col(c).cast("double") for c in ("qty_sum", "qty_min")})


@query("""SELECT o_custkey, o_orderstatus, max(o_totalprice) AS o_totalprice_max, min(o_totalprice) AS o_totalprice_min, CAST(count(o_totalprice) AS BIGINT) AS o_totalprice_count, median(o_totalprice) AS o_totalprice_median
  FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS s FROM orders) WHERE s IS NOT NULL GROUP BY o_custkey, o_orderstatus""")
def aggregate_by_index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")))
    return A.aggregate_by_index_and_keys(df, "o_custkey", ["o_orderstatus"], {"o_totalprice": ["max", "min", "count", "median"]})


@query("""SELECT o_orderkey, k, CASE WHEN k IS NOT NULL THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey, k) AS DOUBLE) END AS total
  FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS k FROM orders)""")
def aggregate_as_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("k"), cents("o_totalprice").alias("p"))
    return A.aggregate_as_column_by_index_and_keys(df, "o_custkey", ["k"], "p", "sum", "total").select("o_orderkey", "k", F.col("total").cast("double").alias("total"))


@query("""SELECT o_orderkey, k, max(o_totalprice) OVER (PARTITION BY k) AS top FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS k FROM orders) WHERE k IS NOT NULL""")
def aggregate_as_column_dropping(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"), "o_totalprice")
    return A.aggregate_as_column(df, "k", "o_totalprice", "max", "top", null_keys="drop").select("o_orderkey", "k", "top")


@query("""SELECT user_id, first(value ORDER BY ts, event_id) AS value_first, last(value ORDER BY ts, event_id) AS value_last FROM (SELECT * FROM events WHERE event_id % 5 <> 0) GROUP BY user_id""")
def aggregate_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed(spark, sf_dir).withColumnRenamed("v", "value")
    return A.aggregate_flat(df, "user_id", {"value": ["first", "last"]}, order_by=["ts", "event_id"]).where("value_first is not null")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (0, 2, 3, 24)")
def drop_rows_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_rows_by_index(table(spark, sf_dir, "nation"), "n_nationkey", [0, 2, 3, 24])


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def drop_duplicates_index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_duplicates_by_index_and_keys(table(spark, sf_dir, "events"), "user_id", ["event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def drop_duplicates_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_duplicates_by_index_and_keys(table(spark, sf_dir, "events"), "user_id", ["event_type"], ["ts", "event_id"], keep="last").select("event_id", "user_id", "event_type")


@query("SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS words FROM part")
def stack_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.stack_list_column(table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " ")), "words", "string", ["p_size"], "p_partkey")


@query("""SELECT p_partkey, unnest(string_split(p_name, ' ')) AS a, unnest(string_split(p_brand || '#' || p_type || '#x', '#')) AS b FROM part""")
def stack_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split(F.concat("p_brand", F.lit("#"), "p_type", F.lit("#x")), "#").alias("b"))
    return reshape.stack_list_columns(df, ["a", "b"], ["string", "string"], [], "p_partkey")


@query("""SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS m_value, 'k' AS m_label FROM events UNION ALL SELECT event_id, user_id, CAST(length(event_type) AS BIGINT), 'n' FROM events""")
def stack_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("bigint"), F.lit("n"), F.length("event_type").cast("bigint"))
    return reshape.stack_dict_column(table(spark, sf_dir, "events").withColumn("m", m), "m", "string", "bigint", ["user_id"], "event_id")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS l_discount, l_tax FROM lineitem)
SELECT l_orderkey, l_linenumber, stack_label, stacked FROM x UNPIVOT (stacked FOR stack_label IN (l_quantity, l_discount, l_tax))""")
def stack_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")))
    return reshape.stack_columns(df, ["l_quantity", "l_discount", "l_tax"], ["l_linenumber"], "l_orderkey")


@query("""SELECT o_orderpriority, max(n) FILTER (WHERE s = 'F') AS F_n, max(n) FILTER (WHERE s = 'O') AS O_n, max(n) FILTER (WHERE s = 'P') AS P_n
  FROM (SELECT o_orderpriority, o_orderstatus AS s, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return reshape.unstack_column(counts, ["o_orderstatus"], ["o_orderpriority"], "n", suffix="_n", pivot_values=["F_n", "O_n", "P_n"])


@query(f"SELECT event_id, NOT coalesce(abs(v - lag(v) OVER w) < 10, false) AS changed FROM (SELECT *, {HOLES} AS v FROM events) WINDOW {EVENTS}")
def value_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed(spark, sf_dir).select("event_id", ts.value_changed("v", ts.ordered("user_id", ["ts", "event_id"]), 10).alias("changed"))


@query(f"""SELECT event_id, NOT coalesce(abs(f - lag(f) OVER w) < 10, false) AS changed FROM (
  SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT *, {HOLES} AS v FROM events)) WINDOW {EVENTS}""")
def value_changed_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed(spark, sf_dir).select("event_id", ts.value_changed("v", ts.ordered("user_id", ["ts", "event_id"]), 10, change_at_nan=False).alias("changed"))


@query(f"SELECT event_id, coalesce(t <> lag(t) OVER w, true) AS changed FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN event_type END AS t FROM events) WINDOW {EVENTS}")
def id_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return df.select("event_id", ts.id_changed("t", ts.ordered("user_id", ["ts", "event_id"])).alias("changed"))


@query(f"SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) + 99 AS grp FROM events WINDOW {EVENTS}")
def grouper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ts.grouper(F.col("event_type") == "click", ts.ordered("user_id", ["ts", "event_id"]), 100).alias("grp"))


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS up, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS BIGINT) AS down FROM events""")
def group_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["ts", "event_id"]
    return table(spark, sf_dir, "events").select("event_id", ts.group_row_number("user_id", order).alias("up"), ts.group_row_number("user_id", order, ascending=False).alias("down"))


def _fill_sql(limit: int) -> str:
    return f"""
WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events
), r AS (SELECT *, row_number() OVER {'w'} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM x WINDOW {EVENTS}
), p AS (
  SELECT *, coalesce(max(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY rn), 0) AS pp,
    coalesce(min(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n + 1) AS np FROM r)
SELECT p.event_id, CASE WHEN p.v IS NOT NULL THEN p.v WHEN p.rn - p.pp <= p.np - p.rn THEN CASE WHEN p.rn - p.pp <= {limit} THEN a.v END ELSE CASE WHEN p.np - p.rn <= {limit} THEN b.v END END AS filled
FROM p LEFT JOIN r a ON a.user_id = p.user_id AND a.rn = p.pp LEFT JOIN r b ON b.user_id = p.user_id AND b.rn = p.np"""


def _filled(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return df.select("event_id", ts.fbfill("v", ts.ordered("user_id", ["ts", "event_id"]), limit).alias("filled"))


@query(_fill_sql(1 << 31))
def fbfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, None)


@query(_fill_sql(1))
def fbfill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, 1)


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'ECO') OR starts_with(p_type, 'SMALL')")
def str_startswith_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(startswith_many(F.col("p_type"), ["ECO", "SMALL"])).select("p_partkey", "p_type")


@query("SELECT p_partkey, coalesce(suffix(n, 'ring') OR suffix(n, 'bolt'), false) AS found FROM (SELECT *, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS n FROM part)")
def str_endswith_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("n", F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")))
    return df.select("p_partkey", endswith_many(F.col("n"), ["ring", "bolt"]).alias("found"))


@query("SELECT p_partkey, coalesce(regexp_matches(n, 'l+ ') OR regexp_matches(n, '^[br]'), false) AS found FROM (SELECT *, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS n FROM part)")
def str_contains_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("n", F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")))
    return df.select("p_partkey", contains_many(F.col("n"), ["l+ ", "^[br]"]).alias("found"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) || '.0' END AS plain, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS tight, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) || '.0' ELSE 'nan' END AS filled FROM part")
def asstr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("d", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("double")))
    return df.select("p_partkey", as_text(F.col("d"), "double").alias("plain"), as_text(F.col("d"), "double", remove_dotzero=True).alias("tight"), as_text(F.col("d"), "double", keep_nan=False).alias("filled"))


def _merge(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """Orders and customers with null keys on both sides. Nulls match nulls: few rows have them on the right, so the result stays in proportion."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("k"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") != 5, F.col("c_custkey")).alias("ck"), "c_name")
    return joins.merge_keep_index(o, c, "k", "ck", how, left_index="o_orderkey", right_index="c_custkey")


def _merge_sql(how: str) -> str:
    return f"""SELECT o_orderkey, k, o_totalprice, c_custkey, ck, c_name FROM (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS k FROM orders) o
  {how} JOIN (SELECT *, CASE WHEN c_custkey <> 5 THEN c_custkey END AS ck FROM customer) c ON k IS NOT DISTINCT FROM ck"""


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    QUERIES[f"merge_keep_index_{_how}"] = lambda spark, sf_dir, how=_how: _merge(spark, sf_dir, how)
    ORACLE_SQL[f"merge_keep_index_{_how}"] = _merge_sql(_sql)


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey")
def merge_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").where("r_regionkey <> 2")
    return joins.merge_broadcast(table(spark, sf_dir, "nation"), lambda: r.select("r_name", "r_regionkey"), "n_regionkey", "r_regionkey", "left", left_index="n_nationkey", right_index="r_regionkey")


@query("SELECT n_nationkey, n_nationkey + j AS v, n_name || j AS label FROM nation, (VALUES (0), (1), (2)) t(j)")
def flatmap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def three(row):
        return [{"v": row["n_nationkey"] + j, "label": f"{row['n_name']}{j}"} for j in range(3)]

    return partitions.flat_map_records(table(spark, sf_dir, "nation"), three, [("v", T.IntegerType()), ("label", "str")], "n_nationkey")


@query("SELECT n_nationkey, n_nationkey + j AS v FROM nation, (VALUES (0), (1)) t(j)")
def flatmap_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def two(row):
        import pandas as pd

        return pd.DataFrame({"v": [row["n_nationkey"], row["n_nationkey"] + 1]})

    return partitions.flat_map_frames(table(spark, sf_dir, "nation"), two, "v int", "n_nationkey")


@query("SELECT p_partkey, p_size * 100 AS scaled FROM part")
def map_partitions_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.map_partitions(table(spark, sf_dir, "part").select("p_partkey", "p_size"), lambda f, by: f.assign(scaled=f.p_size * by, more=1), "p_partkey bigint, scaled int", by=100)


@query("SELECT event_id, user_id, value, event_type FROM events")
def set_index_via_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.set_index_via_disk(table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value"), "event_type", f"{scratch(spark)}/by")


@query("SELECT * FROM orders")
def persist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.persist(table(spark, sf_dir, "orders"), scratch(spark))[0]


@query("SELECT * FROM (VALUES ('dealt anew', true), ('sorted otherwise', true), ('a row less', false), ('a row twice', false), ('a column renamed', false)) t(change, same)")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a table's digest stays the same."""
    o = table(spark, sf_dir, "orders")
    own = digests.digest(o)
    first = o.where(F.col("o_orderkey") == o.agg(F.min("o_orderkey")).first()[0])
    changed = {"dealt anew": o.repartition(7), "sorted otherwise": o.orderBy(F.desc("o_totalprice")), "a row less": o.exceptAll(first), "a row twice": o.union(first), "a column renamed": o.withColumnRenamed("o_custkey", "c")}
    return spark.createDataFrame([(k, digests.digest(df) == own) for k, df in changed.items()], "change string, same boolean")


@query("SELECT n_nationkey, n_name || '/' || n_regionkey AS shown FROM nation")
def object_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").withColumn("o", objects.object_column(lambda n, r: {"n": n, "r": [r]}, "n_name", "n_regionkey"))
    path = f"{scratch(spark)}/objects"
    objects.write_objects(df.select("n_nationkey", "o"), path, ["o"])
    return layout.read_parquet(spark, path).select("n_nationkey", objects.from_objects("o", lambda x: f"{x['n']}/{x['r'][0]}", "string").alias("shown"))


@query("SELECT n_nationkey, n_name || '/' || n_regionkey AS shown FROM nation")
def object_roundtrip_pickle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects.object_column(lambda n, r: {"n": n, "r": {r}}, "n_name", "n_regionkey", codec="pickle")
    path = f"{scratch(spark)}/objects"
    objects.write_objects(table(spark, sf_dir, "nation").select("n_nationkey", o.alias("o")), path, ["o"], "pickle")
    shown = objects.from_objects("o", lambda x: f"{x['n']}/{min(x['r'])}", "string", "pickle", trusted=True)
    return layout.read_parquet(spark, path).select("n_nationkey", shown.alias("shown"))


@query("SELECT c_custkey, c_name || '!' AS o, c_nationkey FROM customer")
def object_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects published through a catalog, copied with a time to live, and read by what the record says."""
    where = scratch(spark)
    catalog = Catalog(f"{where}/catalog.json", spark)
    df = table(spark, sf_dir, "customer").select("c_custkey", objects.object_column(lambda n: [n], "c_name").alias("o"), "c_nationkey")
    copy = object_sources.persist_objects(object_sources.publish_objects(catalog, df, "customers", "1", where, ["o"]), spark, f"{where}/copies", ttl=3600)
    if object_sources.expired(copy) or not object_sources.expired(copy, copy.metadata["exported_at"] + 3600):
        raise AssertionError("a copy lives for its ttl")
    return object_sources.read_objects(catalog.append(copy), spark, {"o": (lambda x: f"{x[0]}!", "string")})


@query("SELECT * FROM supplier")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/csv"
    s = table(spark, sf_dir, "supplier")
    s.write.option("header", True).csv(path)
    return layout.read_csv(spark, path, s.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_source_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/csv"
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    df = layout.read_csv(spark, path)
    return df.select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, c_name, 'BUILDING' AS c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def partition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one partition with its value as a column."""
    root = f"{scratch(spark)}/by"
    by = layout.set_index_via_disk(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_mktsegment", root)
    return layout.read_partition_files(spark, by.where("c_mktsegment = 'BUILDING'").select(F.input_file_name().alias("f")).distinct().toPandas()["f"].tolist(), "c_mktsegment", "BUILDING")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def sorted_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sorted_by(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", 8)


@query("SELECT o_custkey, CAST(any_value(o_orderkey) AS BIGINT) AS o_orderkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) = 1")
def drop_duplicates_keep_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_duplicates_by_index_and_keys(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority"], ["o_orderkey"], keep=False).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber, n FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS f FROM lineitem)
  JOIN (SELECT l_suppkey AS s, CAST(count(DISTINCT CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END) AS BIGINT) AS n FROM lineitem GROUP BY ALL) ON l_suppkey = s""")
def aggregate_nunique_as_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("f", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")))
    return A.aggregate_as_column(df, "l_suppkey", "f", "nunique", "n").select("l_orderkey", "l_linenumber", "n")


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS line_sum, CAST(min(l_linenumber) AS BIGINT) AS line_min FROM lineitem GROUP BY ALL")
def flatten_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.sum("l_linenumber").cast("long").alias("sum"), F.min("l_linenumber").cast("long").alias("min"))
    return A.flatten_names(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(line.alias("line")))


@query("""SELECT o_orderpriority, max(n) FILTER (WHERE s IS NULL) AS null_n, max(n) FILTER (WHERE s = 'F') AS F_n, max(n) FILTER (WHERE s = 'O') AS O_n
  FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def unstack_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels found in the data, a missing one among them; two rows of one place are an error."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s")
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", status).agg(F.count(F.lit(1)).alias("n"))
    try:
        reshape.unstack_column(counts.union(counts), ["s"], ["o_orderpriority"], "n")
    except ValueError:
        return reshape.unstack_column(counts, ["s"], ["o_orderpriority"], "n", suffix="_n")
    raise AssertionError("rows of one place went unnoticed")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) || '.5' WHEN p_partkey % 4 = 1 THEN CAST(p_size AS VARCHAR) || '.25' ELSE '-0.125' END AS shown FROM part")
def asstr_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 0.5).when(F.col("p_partkey") % 4 == 1, F.col("p_size") + 0.25).otherwise(F.lit(-0.125))
    return table(spark, sf_dir, "part").select("p_partkey", as_text(d, "double", remove_dotzero=True).alias("shown"))


@query("SELECT c_custkey, c_name, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def merge_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side as a function that gives a pandas frame."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return joins.merge_broadcast(c, n.toPandas, "c_nationkey", "n_nationkey", "inner", left_index="c_custkey", right_index="n_nationkey").select("c_custkey", "c_name", "n_nationkey", "n_name")


@query("SELECT s_suppkey, s_name FROM supplier")
def catalog_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and recorded only when the job is called, and read back by name."""
    where = scratch(spark)
    catalog = Catalog(f"{where}/catalog.json", spark)
    _, job = catalog.dump(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "suppliers", where, compute=False)
    if "suppliers" in catalog:
        raise AssertionError("recorded before the job ran")
    job()
    return Catalog(f"{where}/catalog.json", spark)["suppliers"].read(spark)


@query("SELECT r_regionkey, r_name FROM region")
def catalog_dump_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark)
    catalog = Catalog(f"{where}/catalog.json", spark)
    catalog.dump_pandas(table(spark, sf_dir, "region").select("r_regionkey", "r_name").toPandas(), "regions", where, partitions=2)
    return catalog["regions"].read(spark)


@query("""SELECT 'n' AS asked, '1.10' AS version, n_nationkey FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'n_1.9', '1.9', n_nationkey FROM nation WHERE n_nationkey < 10
  UNION ALL SELECT 'copy', '1.9', n_nationkey FROM nation WHERE n_nationkey < 10""")
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version by number, a given one, and an exported copy; wrong digests, names and versions are told."""
    where, n = scratch(spark), table(spark, sf_dir, "nation").select("n_nationkey")
    catalog = Catalog(f"{where}/catalog.json", spark)
    old = catalog.publish(n.where("n_nationkey < 10"), "n", "1.9", where)
    catalog.publish_pandas(n.where("n_nationkey < 20").toPandas(), "n", "1.10", where)
    catalog = Catalog(f"{where}/catalog.json", spark)
    for wrong, kind in ((lambda: catalog["m"], KeyError), (lambda: catalog.find("n_1.9", "0"), LineageError), (lambda: catalog.find_version("n", "2"), KeyError), (lambda: catalog.append(Source("n!", "1")), ValueError)):
        try:
            wrong()
        except kind:
            continue
        raise AssertionError("a wrong key was found")
    if not catalog["n_1.9"] == catalog[old] == catalog.find_version("n", "1.9") == old or catalog["n"] != catalog.latest("n"):
        raise AssertionError("one record is another")
    found = {"n": catalog["n"], "n_1.9": catalog["n_1.9"], "copy": old.export(spark, f"{where}/copy")}
    parts = [x.read(spark).select(F.lit(k).alias("asked"), F.lit(x.version).alias("version"), F.col("n_nationkey")) for k, x in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT c_nationkey, n_name, CAST(count(*) AS BIGINT) AS customers, 'c_1,n_1' AS upstream FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def catalog_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of two published tables, published with them as lineage."""
    where = scratch(spark)
    catalog = Catalog(f"{where}/catalog.json", spark)
    catalog.publish(table(spark, sf_dir, "customer"), "c", "1", where)
    catalog.publish(table(spark, sf_dir, "nation"), "n", "1", where)

    @catalog.analysis("per_nation", "1", ["c", "n_1"], where)
    def per_nation(c: DataFrame, n: DataFrame) -> DataFrame:
        return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("c_nationkey", "n_name").agg(F.count(F.lit(1)).alias("customers"))

    done = per_nation()
    return done.read(spark).withColumn("upstream", F.lit(",".join(k for k, _ in done.upstream)))


@query("""SELECT * FROM (VALUES ('as published', 'a_1', true), ('as published', 'b_1', true), ('as published', 'c_1', true), ('after a change upstream', 'a_1', true), ('after a change upstream', 'b_1', false),
  ('after a change upstream', 'c_1', false), ('files spoilt', 'a_1', false)) t(state, record, valid)""")
def catalog_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of three analyses, valid as published, invalid from where an upstream was published anew; and a table whose files changed behind its record."""
    where, n = scratch(spark), table(spark, sf_dir, "nation")
    catalog = Catalog(f"{where}/catalog.json", spark)
    catalog.analysis("a", "1", [], where)(lambda: n)()
    catalog.analysis("b", "1", ["a"], where)(lambda a: a.select("n_name"))()
    catalog.analysis("c", "1", ["b"], where)(lambda b: b.distinct())()
    out = [("as published", key, rows[-1][1]) for key, rows in catalog.validate(deep=True)[1].items()]
    catalog.publish(n.where("n_nationkey > 3"), "a", "1", where)
    out += [("after a change upstream", key, rows[-1][1]) for key, rows in catalog.validate()[1].items()]
    n.limit(2).write.mode("overwrite").parquet(catalog["a_1"].path)
    return spark.createDataFrame([*out, ("files spoilt", "a_1", catalog.validate(deep=True)[1]["a_1"][-1][1])], "state string, record string, valid boolean")


@query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS nations FROM nation GROUP BY ALL")
def notebook_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line magics of a notebook, from the start of a project to the end of an analysis, in a shell of this query's own."""

    class Shell:
        def __init__(self):
            self.user_ns, self.magics = {}, {}

        def register_magic_function(self, function, kind, name):
            self.magics[name] = function

    where, shell = scratch(spark), Shell()
    session = AnalysisSession()
    load_magics(shell, session)
    with contextlib.redirect_stdout(io.StringIO()) as said:
        shell.magics["start_nb"](f"project {where}/catalog.json {where}")
        session.catalog.publish(table(spark, sf_dir, "nation"), "nation", "1", where)
        shell.magics["begin_analysis"]("per_region 1")
        shell.magics["add_analysis_upstream"]("nation")
        shell.user_ns["out"] = shell.user_ns["nation"].groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"))
        done = shell.magics["end_analysis"]("out")
        shell.magics["validate_catalog"]("")
    if "catalog valid" not in said.getvalue():
        raise AssertionError(said.getvalue())
    return done.read(spark)


@query("""SELECT * FROM (VALUES ('parts', 'b', 'x/y', 's3a://b/x/y'), ('prefixed', 'b', 'x', 's3a://b/x'), ('local', NULL, NULL, 'x/y')) t(what, bucket, key, as_spark_reads_it)""")
def paths_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two, local = S3URL("s3://b/") / "x" / "y", local_or_s3("s3://b/x"), local_or_s3("x") / "y"
    return spark.createDataFrame([("parts", one.bucket(), one.key(), spark_path(one)), ("prefixed", two.bucket(), two.key(), spark_path(two)), ("local", None, None, spark_path(local))], "what string, bucket string, key string, as_spark_reads_it string")


@query("SELECT 'nations' AS name, CAST(count(*) AS BIGINT) AS cells FROM nation UNION ALL SELECT 'text', 0")
def chart_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame and a text kept as HTML by name in a folder of the driver's own, reread by another store and served."""
    with tempfile.TemporaryDirectory() as folder:
        store = ChartStore(folder)
        store["nations"] = table(spark, sf_dir, "nation").select("n_name").toPandas()
        store["text"] = "<b>none</b>"
        server = serve(ChartStore(folder))
        threading.Thread(target=server.serve_forever, daemon=True).start()
        rows = [(k, urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/charts/{k}").read().decode().count("<td>")) for k in ("nations", "text")]
        server.shutdown()
    return spark.createDataFrame(rows, "name string, cells long")


@query("SELECT DISTINCT o_orderstatus AS column, 'string' AS kind FROM orders WHERE false UNION ALL SELECT * FROM (VALUES ('i', 'bigint'), ('a', 'double'), ('b', 'string'), ('t', 'timestamp_ntz')) t")
def make_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = schemas.make_schema(("i", "int"), [("a", "float"), ("b", object), ("t", "datetime64[ns]")])
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in kind.fields], "column string, kind string")

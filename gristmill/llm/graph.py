"""Connected components by contraction: every root points to the first in a random order within two steps of it, and edges are contracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """id, component for each id of edges (a long, b long); component is the smallest id that it can reach.

    Ids, labels and edges stay in tables; the driver only asks whether edges are left. A star is gone after one round; of a chain, each
    round leaves a small share, as the order is drawn anew. An edge that joins an id to itself says nothing."""
    live = cut(ordered(edges.select("a", "b")), ids=True)
    labels = live.select(F.col("a").alias("id")).union(live.select(F.col("b").alias("id"))).distinct().withColumn("component", F.col("id"))
    rounds = 0
    while not live.isEmpty():
        parent = cut(pointers(live, rounds), ids=True)
        labels = relabel(labels, "component", parent)
        live = cut(ordered(relabel(relabel(live, "a", parent), "b", parent)), ids=True)
        rounds += 1
        if rounds % 4 == 0:
            labels = cut(labels, ids=True)
    labels = cut(labels, ids=True)
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return labels.join(least, "component").select("id", F.col("least").alias("component"))


def pointers(live: DataFrame, salt: int) -> DataFrame:
    """id, up for each end of an edge: the first within two steps, itself included."""

    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("draw"), F.col(c).alias("to"))

    both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select("a", F.least(rank("a"), "near").alias("near"))
    two = both.join(one.select(F.col("a").alias("b"), "near"), "b").groupBy("a").agg(F.min("near").alias("further"))
    return two.select(F.col("a").alias("id"), F.least(rank("a"), "further")["to"].alias("up"))


def ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def relabel(rows: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    found = rows.join(parent.withColumnRenamed("id", "__id"), F.col(column) == F.col("__id"), "left")
    return found.withColumn(column, F.coalesce("up", column)).drop("__id", "up")

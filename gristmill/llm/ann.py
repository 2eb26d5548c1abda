"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, as flat neighbour arrays, and merged shard results.

Equal vectors are one class, with the smallest ids that a result can need; the graphs hold classes, so any number of copies of a vector costs one node.
Classes are dealt to shards of about SHARD by a hash. A shard's index is one row: ids, vectors, levels, and for every layer an int array
of fixed width per node, filled up with -1. Queries go to every shard, where they pass by its graph in Arrow batches: an index is moved once, and a task holds one
index and one batch of queries. A shard gives its best classes with their exact cosines, and the merge keeps the nearest ones.

Vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as candidates. A null id takes no part. Vectors of
other lengths than a query's have no cosine with it: each length has shards of its own, and a query's candidates are those of its length. Repeated rows with one id are one candidate;
of queries with one id and several vectors one is asked. Ties go to the smaller id. An empty table gives an empty result. Scores are computed in double precision from the original components.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, small

SHARD = 4096
M = 16
EF_BUILD = 64
EF_SEARCH = 96
EVERY = 50
TOP = 5


class Hnsw:
    """A graph over unit vectors. near[l][i] holds node i's neighbours on layer l, width M (2 M on layer 0), filled up with -1."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7):
        self.v, self.m, self.ef = vectors, m, ef
        n = len(vectors)
        self.level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / math.log(m)).astype(np.int32), 6)
        self.near = [np.full((n, m * 2 if l == 0 else m), -1, np.int32) for l in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        self.seen = np.zeros(n, np.int64)
        self.mark = 0

    @classmethod
    def built(cls, vectors: np.ndarray, **how) -> Hnsw:
        graph = cls(vectors, **how)
        for i in range(len(vectors)):
            graph.insert(i)
        return graph

    def greedy(self, q: np.ndarray, at: int, layer: int) -> int:
        best = float(self.v[at] @ q)
        while True:
            near = self.near[layer][at]
            near = near[near >= 0]
            if not len(near):
                return at
            s = self.v[near] @ q
            k = int(s.argmax())
            if s[k] <= best:
                return at
            best, at = float(s[k]), int(near[k])

    def search(self, q: np.ndarray, at: int, layer: int, ef: int) -> list[tuple[float, int]]:
        """The ef best found (similarity, node), best first."""
        self.mark += 1
        mark, seen, near, v = self.mark, self.seen, self.near[layer], self.v
        s = float(v[at] @ q)
        seen[at] = mark
        todo, found = [(-s, at)], [(s, at)]
        while todo:
            s, at = heapq.heappop(todo)
            if len(found) >= ef and -s < found[0][0]:
                break
            near_at = near[at]
            fresh = near_at[(near_at >= 0) & (seen[near_at] != mark)]
            if not len(fresh):
                continue
            seen[fresh] = mark
            scores = v[fresh] @ q
            if len(found) >= ef:
                good = scores > found[0][0]
                fresh, scores = fresh[good], scores[good]
            for x, s in zip(fresh.tolist(), scores.tolist()):
                if len(found) < ef:
                    heapq.heappush(found, (s, x))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, x))
                else:
                    continue
                heapq.heappush(todo, (-s, x))
        return sorted(found, reverse=True)

    def chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first: one that is nearer to a chosen one than to the node waits."""
        ids = np.array([x for _, x in found])
        if len(ids) <= most:
            return ids.tolist()
        between = self.v[ids] @ self.v[ids].T
        kept: list[int] = []
        rest: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(kept) == most:
                break
            (kept if not kept or between[k, kept].max() < s else rest).append(k)
        return ids[(kept + rest)[:most]].tolist()

    def insert(self, i: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            self.entry = i
            return
        q, at, high = self.v[i], self.entry, int(self.level[self.entry])
        for layer in range(high, top, -1):
            at = self.greedy(q, at, layer)
        for layer in range(min(top, high), -1, -1):
            found = self.search(q, at, layer, self.ef)
            near = self.near[layer]
            mine = self.chosen(found, self.m)
            near[i, : len(mine)] = mine
            for x in mine:
                row = near[x]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                    continue
                own = np.append(row, np.int32(i))
                s = self.v[own] @ self.v[x]
                order = np.argsort(-s)
                picked = self.chosen([(float(s[k]), int(own[k])) for k in order], len(row))
                row[:] = -1
                row[: len(picked)] = picked
            at = found[0][1]
        if top > high:
            self.entry = i

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        if self.entry < 0:
            return []
        at = self.entry
        for layer in range(int(self.level[self.entry]), 0, -1):
            at = self.greedy(q, at, layer)
        return [x for _, x in self.search(q, at, 0, ef)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (double) of the rows that take part."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & some)


def classes(rows: DataFrame, top: int = TOP) -> DataFrame:
    """node (smallest id), ids (the top + 1 smallest), embedding of each distinct vector: what any result can need of it."""
    ids = rows.select("embedding", "vec_id").distinct()
    first = Window.partitionBy("embedding").orderBy("vec_id")
    least = ids.withColumn("k", F.row_number().over(first)).where(F.col("k") <= top + 1)
    return least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "embedding")


INDEX = "width int, shard int, ids binary, n_ids binary, vectors binary, level binary, near array<binary>, entry int"


def dealt(nodes: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(nodes with width and shard, numbered within a width; width and its number of shards). shard: about so many vectors are what a task holds."""
    sized = nodes.withColumn("width", F.size("embedding"))
    shards = cut(sized.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("shards")), ids=True)
    return sized.join(small(shards), "width").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).drop("shards"), shards


def build_index(nodes: DataFrame, n: int, m: int = M, ef: int = EF_BUILD) -> DataFrame:
    """One row a shard of nodes (node, ids, embedding, width, shard); n: their number."""
    unit, graph_of = unit_rows, Hnsw.built

    def build(given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("node")
        v = np.array(given["embedding"].tolist(), np.float64)
        graph = graph_of(unit(v), m=m, ef=ef)
        ids = given["ids"].tolist()
        return pd.DataFrame([{
            "width": v.shape[1], "shard": given["shard"].iloc[0], "ids": np.concatenate(ids).astype(np.int64).tobytes(), "n_ids": np.array([len(x) for x in ids], np.int32).tobytes(),
            "vectors": v.tobytes(), "level": graph.level.tobytes(), "near": [x.tobytes() for x in graph.near], "entry": graph.entry,
        }])

    # by ranges and by number: hashing the few numbers, or joining small partitions, would give a task several graphs to build
    return nodes.repartitionByRange(n, "width", "shard").groupBy("width", "shard").applyInPandas(build, INDEX)


def scaled_rows(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which no cosine sees, so that squares of huge or tiny components stay finite."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = scaled_rows(v)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


class Shard:
    """An index row, ready to be asked."""

    def __init__(self, row: dict, graph: type[Hnsw], unit, scaled, m: int):
        self.scaled, self.unit = scaled, unit
        self.v = scaled(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["width"]))
        self.graph = graph(unit(self.v), m=m)
        self.graph.level = np.frombuffer(row["level"], np.int32)
        self.graph.near = [np.frombuffer(x, np.int32).reshape(len(self.v), -1) for x in row["near"]]
        self.graph.entry = row["entry"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(row["n_ids"], np.int32))))
        self.norms = np.sqrt((self.v * self.v).sum(1))

    def best(self, query: int, vector: list[float], top: int, ef: int) -> list[tuple[int, int, float]]:
        """(query, id, cosine) of the top nearest classes' ids."""
        asked = self.scaled(np.array([vector], np.float64))
        q = asked[0]
        found = self.graph.nearest(self.unit(asked)[0], ef)
        scores = (self.v[found] @ q) / (self.norms[found] * math.sqrt(q @ q))
        every = [(-s, x) for s, k in zip(scores.tolist(), found, strict=True) for x in self.ids[self.starts[k] : self.starts[k + 1]].tolist() if x != query]
        return [(query, x, -s) for s, x in heapq.nsmallest(top, every)]


def search_index(index: DataFrame, queries: DataFrame, shards: DataFrame, n: int, top: int = TOP, ef: int = EF_SEARCH, m: int = M) -> DataFrame:
    """query_id, vec_id, score: each shard's best candidates for each query (vec_id, embedding). shards: width and its number of shards, n in all.

    Index and queries meet in one partition, sorted: an index row, then all queries of its shard."""
    kind, of, unit, scaled = Hnsw, Shard, unit_rows, scaled_rows
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for row in batch.to_pylist():
                if row["vec_id"] is None:
                    shard = of(row, kind, unit, scaled, m)
                else:
                    found += shard.best(row["vec_id"], row["embedding"], top, ef)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    asked = queries.withColumn("width", F.size("embedding")).join(small(shards), "width").select("width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "vec_id", "embedding")
    both = index.unionByName(asked, allowMissingColumns=True).repartitionByRange(n, "width", "shard").sortWithinPartitions("width", "shard", F.asc_nulls_first("vec_id"))
    return both.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, shard: int = SHARD, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the top nearest of all others found."""
    rows = usable(vectors)
    nodes, shards = dealt(cut(classes(rows, top)), shard)
    n = max(1, int(shards.agg(F.sum("shards")).first()[0] or 0))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    found = search_index(cut(build_index(nodes, n)), queries, shards, n, top, ef)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line, stripped of ASCII white space and with A-Z lower-cased, as 128 bits of xxh3. A run is a table of
(key, documents that hold it, largest doc_id), bucketed and sorted by key. Each batch of documents is summed to such rows, merge-anti-joins
the runs (rows that can't change a verdict any more, as one run already has the key often enough and in a larger document, go), and adds the
rest as a run of level 0. When a level has FANOUT runs they are merged into one of the next level. The runs' bucketing spares
them the shuffle in every later join.

Keys of at least `least` code points in at least `copies` documents lose all their lines but those in the largest doc_id.
Nulls: a null text is one empty line; rows without doc_id take no part and keep their lines. Rows that share a doc_id are one
document for counting, and each keeps or loses its own lines. Empty tables give empty results. Texts are split whole; a batch must hold
documents that no earlier batch held. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, own_folder, remove, replaced, small

LEAST = 20
COPIES = 3
#: Batches in which the query takes its table, and runs that a level holds before they are merged.
BATCHES = 4
FANOUT = 3
BLANK = b" \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """The 16 bytes of a line's key, or None if it has fewer than least code points."""
    line = line.strip(BLANK)
    if len(line) < least or not line.isascii() and len(line.decode("utf-8", "surrogatepass")) < least:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """hi, lo, doc_id for each different key of each row; narrow."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found, counts = [], []
                for text in part.column(1).to_pylist():
                    own = {key_of(line, least) for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")} - {None}
                    found += own
                    counts.append(len(own))
                both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), ids], names=["hi", "lo", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return rows.mapInArrow(keys, "hi long, lo long, doc_id long")


class LineRuns:
    """Levelled runs in tables whose files lie under path."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, buckets: int | None = None, copies: int = COPIES):
        self.spark, self.path, self.fanout, self.copies = spark, path, fanout, copies
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, keys: DataFrame) -> None:
        """keys: hi, lo, doc_id of new documents."""
        new = keys.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        for table in self.runs():
            run = self.spark.table(table).where(F.col("n") >= self.copies).select(*KEY, F.col("last").alias("run_last"))
            settled = (new["hi"] == run["hi"]) & (new["lo"] == run["lo"]) & (run["run_last"] >= new["last"])
            new = new.join(run.hint("merge"), settled, "left_anti")
        self._put(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _put(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        table = f"{self.name}_{self.made}"
        self.made += 1
        rows.select(*KEY, "n", "last").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{table}").saveAsTable(table)
        self.levels[level].append(table)

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._put(self._sum(old), level + 1)
        for table in old:
            self._drop(table)

    def _sum(self, tables: list[str]) -> DataFrame:
        # by their files: Spark 4.1 takes a union of bucketed tables for bucketed likewise, leaves out the shuffle, and splits keys between tasks
        rows = self.spark.read.schema("hi long, lo long, n long, last long").parquet(*[f"{self.path}/{t}" for t in tables])
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def repeated(self) -> DataFrame:
        """hi, lo, last of the keys that enough documents hold."""
        return self._sum(self.runs()).where(F.col("n") >= self.copies).select(*KEY, "last")

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, f"{self.path}/{table}")

    def drop(self) -> None:
        for table in self.runs():
            self._drop(table)
        remove(self.spark, self.path)
        self.levels = []


def lost_keys(docs: DataFrame, least: int = LEAST, copies: int = COPIES, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, lost: the low halves of the keys whose lines the document loses. Only documents that lose some have a row."""
    spark = docs.sparkSession
    keys = cut(line_keys(docs, least))
    runs = LineRuns(spark, own_folder(spark, "line-runs"), fanout, copies=copies)
    try:
        for k in range(batches):
            runs.add(keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
        repeated = cut(runs.repeated())
    finally:
        runs.drop()
    held = keys.join(small(repeated), KEY).where(F.col("doc_id") < F.col("last"))
    return held.groupBy("doc_id").agg(F.collect_set("lo").alias("lost"))


def kept_text(text: str | None, lost: list[int] | None, least: int = LEAST) -> tuple[bytes, int, int]:
    """(what stays, lines before, lines dropped)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    if not lost:
        return b"\n".join(lines), len(lines), 0
    gone = set(lost)
    kept = [x for x in lines if (k := key_of(x, least)) is None or int.from_bytes(k[8:], "little", signed=True) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dropped(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs with __lost beside their columns. This shuffle of the texts by doc_id is the operator's only one."""
    return docs.join(lost.select(F.col("doc_id").alias("__id"), F.col("lost").alias("__lost")), F.col("doc_id") == F.col("__id"), "left").drop("__id")


def line_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs (doc_id, text)."""
    least = how.get("least", LEAST)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kept_text(t.as_py(), x.as_py(), least) for t, x in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b, *_ in found], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    both = dropped(docs.select(F.col("doc_id").cast("long"), "text"), lost_keys(docs, **how))
    return both.mapInArrow(report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with what stays of each text; a column n_chars, if there is one, is counted anew. Null texts stay null; other columns stay as they are."""
    least, columns = how.get("least", LEAST), docs.columns
    kind = docs.schema["n_chars"].dataType.simpleString() if "n_chars" in columns else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = batch.column(at("text"))
            new = [None if not t.is_valid else kept_text(t.as_py(), x.as_py(), least)[0].decode("utf-8", "surrogatepass") for t, x in zip(texts, batch.column(at("__lost")), strict=True)]
            more = {"n_chars": pa.array([None if t is None else len(t) for t in new], batch.column(at("n_chars")).type)} if kind else {}
            yield replaced(batch, columns, text=pa.array(new, texts.type), **more)

    return dropped(docs, lost_keys(docs, **how)).mapInArrow(rewrite, docs.schema)


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

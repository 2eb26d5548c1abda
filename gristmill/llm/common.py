"""What the operators of this folder share: reading, cutting lineage, and row functions over Arrow batches."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a broadcast side may have at most. Such sides hold a few short columns, so 100,000 rows are some MB.
BROADCAST_ROWS = 100_000
#: Slots that ids are hashed to where a filter in front of a shuffle needs no exact answer: as many numbers are broadcast at most, whatever the data.
ID_SLOTS = 1 << 20
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only where none is set, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. It is deleted when the application ends in good order, as nothing else tells when its tables are read for the last time."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def cut(df: DataFrame, ids: bool = False) -> DataFrame:
    """df computed once and kept in the shared folder. Where spark.cleaner.referenceTracking.cleanCheckpoints is set, Spark removes the files when nothing refers
    to them any more; without it they stay until the folder is emptied.

    ids: for a table of a few numbers a row, far smaller than the texts that the shuffle partitions are counted for: its rows are dealt anew to a quarter as many files,
    2 at least; the tasks that make them stay as many as they are."""
    shared_dir(df.sparkSession)
    return (df.repartition(max(2, number_of_partitions(df.sparkSession) // 4)) if ids else df).checkpoint()


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else as it is: then Spark shuffles and splits skewed keys.

    rows: its count where known; df should be cheap to count, such as a checkpoint."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def slot_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(ID_SLOTS)).cast("int")


def maybe_in(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose column may be among that of ids: all that are, and others that share a slot with one. Nothing is shuffled but ids' slots. With far more ids than
    slots nearly all rows pass, which costs the shuffle that follows what it would have cost anyway."""
    slots = ids.select(slot_of(F.col(column)).alias("__slot")).distinct()
    return rows.join(F.broadcast(slots), slot_of(F.col(column)) == F.col("__slot"), "left_semi")


def n_words(text: Column) -> Column:
    """The number of runs of other characters than ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_map(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | T.StructType, at_once: int = 2048, max_bytes: int = 8 << 20) -> DataFrame:
    """rows(iterator of tuples of df's values) gives the tuples of the result. One call serves a whole partition, but only Arrow batches are ever held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held, size = [], 0
        for row in rows(given()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if len(held) >= at_once or size >= max_bytes:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def number_of_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(name: str, make: Callable[[], object]) -> object:
    """make()'s value, kept by name as long as this process lives: functions that are pickled by value have no module whose globals last from task to task."""
    kept = sys.__dict__.setdefault("_gristmill_once", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replaced(batch: pa.RecordBatch, columns: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The named columns of batch, with some of them replaced."""
    at = batch.schema.get_field_index
    return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(at(c)) for c in columns], names=columns)

"""From raw documents to packed batches: STAGES, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but the last, which returns each document's place in a batch. run() writes what a stage returns
as Parquet in a folder that the cluster shares and rereads it for the next one, so each stage's work is done once; that folder goes when the application ends.
Nulls, empty texts, repeated rows and empty tables are treated as the operators' own descriptions say; null or letterless texts go in the
first stage. After the mix, a document taken more than once has more than one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import langid, linededup, mixing, neardup, packing
from gristmill.llm.common import own_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go."""
    return langid.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them only."""
    return linededup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return neardup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out until the sources have their shares."""
    return mixing.mix_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every row."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: A model and a search for near duplicates are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = own_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
    return docs

"""Tables on disk: written once and read back, or laid out by a column."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import name
from .paths import local_or_s3, spark_path


def read_csv(spark: SparkSession, path, schema=None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which costs a pass over the file."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(spark_path(path))


def read_parquet(spark: SparkSession, *paths) -> DataFrame:
    return spark.read.parquet(*map(spark_path, paths))


def persist(df: DataFrame, folder, **options) -> tuple[DataFrame, str]:
    """(df read back from a new folder in folder, that folder's name). Lineage ends there, and the files outlive the executors."""
    key = uuid.uuid4().hex
    path = spark_path(local_or_s3(folder) / key)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path), key


def set_index_via_disk(df: DataFrame, column: str, root, **options) -> DataFrame:
    """df written in a folder for each value of column and read back, so that filters on column read their folders alone. Types and columns stay
    as they were; the column comes last. Rows are dealt by column and a random salt first, so a folder gets few files and a hot value several tasks."""
    path, kind = spark_path(root), df.schema[column].dataType
    salt = F.floor(F.rand(7) * 4)
    df.repartition(name(column), salt).write.mode("errorifexists").options(**options).partitionBy(column).parquet(path)
    return read_partitioned(df.sparkSession, path, column, kind)


def read_partitioned(spark: SparkSession, root, column: str, kind=None) -> DataFrame:
    """The table under root with its partition column as kind: folder names alone would be read as numbers or dates where they look so."""
    df = spark.read.parquet(spark_path(root))
    if kind is None:
        return df
    fields = [f if f.name != column else T.StructField(column, kind) for f in df.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(spark_path(root))


def read_partition_files(spark: SparkSession, files: Sequence, column: str, value) -> DataFrame:
    """Files of one partition, with its value as a column."""
    return spark.read.parquet(*map(spark_path, files)).withColumn(column, F.lit(value))


def sorted_by(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """The in-memory counterpart: ranges of column, each sorted."""
    ranged = df.repartitionByRange(partitions, name(column)) if partitions else df.repartitionByRange(name(column))
    return ranged.sortWithinPartitions(name(column))

"""A digest of a table's content that no order or partitioning changes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import name


def digest(df: DataFrame) -> str:
    """MD5 over names, types, number of rows and the sums of two 64-bit hashes of each row: one pass, one row to the driver.

    Nulls count by place; NaN equals NaN and -0.0 equals 0.0; maps are compared as sets of entries. Nullability does not count."""
    row = F.to_json(F.struct(*[_plain(name(c), df.schema[c].dataType).alias(f"c{k}") for k, c in enumerate(df.columns)]), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")), F.lit(0)).cast("string") for salt in ("a", "b")]
    n, one, two = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = [[c, t] for c, t in df.dtypes]
    return hashlib.md5(f"{kinds}|{n}|{one}|{two}".encode()).hexdigest()


def _plain(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(_plain(e["key"], kind.keyType).alias("k"), _plain(e["value"], kind.valueType).alias("v")), {"ignoreNullFields": "false"})))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_plain(c[f.name], f.dataType).alias(f"c{k}") for k, f in enumerate(kind.fields)])) if kind.fields else c
    return c

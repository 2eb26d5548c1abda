"""Schemas from (name, type) pairs, with the type names of data frames understood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

ALIASES = {
    "int": "bigint", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "float": "double", "float64": "double", "float32": "float", "object": "string", "str": "string",
    "bool": "boolean", "datetime64[ns]": "timestamp_ntz", "category": "string", "bytes": "binary",
}


def data_type(kind: str | type | T.DataType) -> T.DataType:
    if isinstance(kind, T.DataType):
        return kind
    text = kind.__name__ if isinstance(kind, type) else str(kind)
    return T._parse_datatype_string(ALIASES.get(text, text))


def make_schema(index: tuple[str | None, object] | None, columns: Sequence[tuple[str, object]]) -> T.StructType:
    """The index, if it has a name, then the columns, in order."""
    first = [index] if index and index[0] is not None else []
    return T.StructType([T.StructField(n, data_type(k)) for n, k in [*first, *columns]])

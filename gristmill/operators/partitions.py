"""Python functions over partitions, and rows made from each row by a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import name, names
from ..functions.schema import make_schema


def map_partitions(df: DataFrame, function: Callable[..., pd.DataFrame], schema: T.StructType | str, whole_partition: bool = False, **kwargs) -> DataFrame:
    """function(frame, **kwargs) for each Arrow batch, or with whole_partition for each partition at once, which then must fit a worker's
    memory. Of its result, the schema's columns are taken by name and order."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = kind.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if whole_partition:
            held = list(frames)
            frames = iter([pd.concat(held, ignore_index=True)] if held else [])
        for frame in frames:
            yield function(frame, **kwargs)[columns]

    return df.mapInPandas(run, kind)


def flat_map_records(df: DataFrame, function: Callable[[Mapping], Sequence[Mapping]], schema: T.StructType | str | Sequence[tuple[str, object]], index: str | Sequence[str] = ()) -> DataFrame:
    """The records (mappings) that function gives for each row, one row each, after the source row's index columns."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema) if isinstance(schema, str) else make_schema(None, schema)
    columns, index = kind.names, names(index)
    whole = T.StructType([*[df.schema[c] for c in index], *kind.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[list] = []
            for row in frame.to_dict("records"):
                kept = [row[c] for c in index]
                out += [[*kept, *[r[c] for c in columns]] for r in function(row)]
            yield pd.DataFrame(out, columns=[*index, *columns])

    return df.mapInPandas(run, whole)


def flat_map_frames(df: DataFrame, function: Callable[[Mapping], pd.DataFrame], schema, index: str | Sequence[str] = ()) -> DataFrame:
    """As flat_map_records(), for a function that gives a pandas frame for each row; the frame's own index is dropped."""

    def records(row: Mapping) -> list[dict]:
        return function(row).to_dict("records")

    return flat_map_records(df, records, schema, index)


def inline_records(df: DataFrame, column: str, index: str | Sequence[str] = ()) -> DataFrame:
    """The records of an array-of-struct column, one row each, without leaving the JVM."""
    return df.select(*[name(c) for c in names(index)], F.inline(name(column)))

"""Tables with object columns in a catalog: the record says which columns are encoded and how, so readers need not be told."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import Catalog, Source
from .objects import from_objects, write_objects
from .paths import local_or_s3


def publish_objects(catalog: Catalog, df: DataFrame, name: str, version: str, folder, columns: Sequence[str], codec: str = "json", upstream: Sequence[Source] = ()) -> Source:
    """As Catalog.publish(), for a table whose named columns hold encoded objects."""
    strange = [c for c in columns if dict(df.dtypes).get(c) != "string"]
    if strange:
        raise ValueError(f"columns that aren't encoded text: {strange}")
    return catalog.publish(df, name, version, folder, upstream, {"object_columns": list(columns), "codec": codec})


def read_objects(source: Source, spark: SparkSession, decoders: Mapping[str, tuple[Callable, T.DataType | str]], trusted: bool = False) -> DataFrame:
    """The table of source, with (function, type) of decoders applied to the objects of each column that its record names; columns without a decoder stay encoded."""
    own = source.metadata.get("object_columns")
    if own is None:
        raise ValueError(f"{source.key} records no object columns")
    strange = set(decoders) - set(own)
    if strange:
        raise ValueError(f"columns that hold no objects: {sorted(strange)}")
    df = source.read(spark)
    return df.withColumns({c: from_objects(c, function, kind, source.metadata["codec"], trusted) for c, (function, kind) in decoders.items()})


def persist_objects(source: Source, spark: SparkSession, folder, ttl: float | None = None, **options) -> Source:
    """A copy of source's table under folder, as encoded as it was. ttl: seconds after which expired() holds for it."""
    path = local_or_s3(folder) / source.key
    noted = write_objects(source.read(spark), str(path), source.metadata["object_columns"], source.metadata["codec"], **options)
    return Source(**{**asdict(source), "path": str(path), "metadata": {**source.metadata, **noted, "exported_from": source.path, "exported_at": time.time(), "ttl": ttl, "options": options}})


def expired(source: Source, now: float | None = None) -> bool:
    """Whether a copy that persist_objects() made has outlived its ttl."""
    ttl = source.metadata.get("ttl")
    return ttl is not None and (time.time() if now is None else now) >= source.metadata["exported_at"] + ttl

"""Columns of Python objects, kept encoded as text and decoded only where they are used.

JSON is the default. Pickles run code when they are read, so decoding them needs trusted=True.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import name
from .paths import spark_path

CODECS = ("json", "pickle")


def encode(value, codec: str = "json") -> str | None:
    if codec not in CODECS:
        raise ValueError(f"codec is one of {CODECS}")
    if value is None:
        return None
    return json.dumps(value, sort_keys=True) if codec == "json" else base64.b64encode(pickle.dumps(value)).decode("ascii")


def decode(text: str | None, codec: str = "json", trusted: bool = False):
    if codec not in CODECS:
        raise ValueError(f"codec is one of {CODECS}")
    if codec == "pickle" and not trusted:
        raise PermissionError("unpickling runs code from the data; pass trusted=True if you trust it")
    if text is None:
        return None
    return json.loads(text) if codec == "json" else pickle.loads(base64.b64decode(text))


def object_column(function: Callable, *columns: str, codec: str = "json") -> Column:
    """The objects that function makes of these columns, encoded."""
    return F.udf(lambda *values: encode(function(*values), codec), "string", useArrow=True)(*[name(c) for c in columns])


def from_objects(column: str, function: Callable, kind: T.DataType | str, codec: str = "json", trusted: bool = False) -> Column:
    """function of each decoded object; null stays null."""
    if codec == "pickle" and not trusted:
        raise PermissionError("unpickling runs code from the data; pass trusted=True if you trust it")
    return F.udf(lambda text: None if text is None else function(decode(text, codec, trusted)), kind, useArrow=True)(name(column))


def write_objects(df: DataFrame, path, columns: Sequence[str], codec: str = "json", **options) -> dict:
    """Writes df, whose object columns are encoded, and gives the metadata that its catalog record should carry."""
    strange = [c for c in columns if dict(df.dtypes).get(c) != "string"]
    if strange:
        raise ValueError(f"columns that aren't encoded text: {strange}")
    df.write.options(**options).parquet(spark_path(path))
    return {"object_columns": list(columns), "codec": codec}

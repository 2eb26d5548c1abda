"""Aggregate functions by name, with missing values left out as in data frames: an empty sum is 0, an empty mean null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .nulls import name

Function = str | Callable


#: What a group without any value gives, where that isn't null.
EMPTY = {"sum": 0, "prod": 1.0, "any": False, "all": True}


def aggregate(column: str, function: Function, order_by: Sequence[str] = (), over: WindowSpec | None = None, kind: str = "double") -> Column:
    """function over column, for a group or over a window. first and last need order_by. A callable gets a pandas Series and gives a value of the
    type `kind` (or of its attribute `returns`, if it has one)."""
    c = name(column)
    if function == "nunique" and over is not None:
        # nulls last in both orders: a value's two ranks count the values before and after it, a null's rank all of them and itself. No group is held in memory
        up, down = (F.dense_rank().over(over.orderBy(o)).cast("long") for o in (c.asc_nulls_last(), c.desc_nulls_last()))
        return F.when(c.isNull(), up - 1).otherwise(up + down - 1)
    value = _pandas(c, function, kind) if callable(function) else _built_in(c, function, order_by)
    if over is not None:
        value = value.over(over)
    return F.coalesce(value, F.lit(EMPTY[function])) if isinstance(function, str) and function in EMPTY else value


def _pandas(c: Column, function: Callable, kind: str) -> Column:
    import pandas as pd

    def own(values: pd.Series) -> float:
        return function(values)

    own.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(own, getattr(function, "returns", kind))(c)


def _built_in(c: Column, function: str, order_by: Sequence[str]) -> Column:
    if function in ("first", "last"):
        if not order_by:
            raise ValueError(f"{function} needs order_by")
        place = F.when(c.isNotNull(), F.struct(*[name(o) for o in order_by]))
        return (F.min_by if function == "first" else F.max_by)(c, place)
    simple: dict[str, Callable[[], Column]] = {
        "sum": lambda: F.sum(c),
        "mean": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "count": lambda: F.count(c),
        "size": lambda: F.count(F.lit(1)),
        "nunique": lambda: F.count_distinct(c),
        "std": lambda: F.stddev_samp(c),
        "var": lambda: F.var_samp(c),
        "median": lambda: F.median(c),
        "quantile": lambda: F.percentile(c, F.lit(0.5)),
        "prod": lambda: F.product(c),
        "any": lambda: F.bool_or(c),
        "all": lambda: F.bool_and(c),
    }
    if function not in simple:
        raise ValueError(f"no aggregate function {function!r}")
    return simple[function]()


def label(function: Function) -> str:
    return function if isinstance(function, str) else function.__name__

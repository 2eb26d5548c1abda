"""Operators over ordered rows: changes, groups between changes, row numbers, and gaps filled from the nearest side.

All take order_by with a unique last column, and partition_by; without partition_by one task gets all rows. Those with one partition_by share
one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

from ..functions.nulls import name, names, no_nan, or_false, or_true

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def ordered(partition_by: str | Sequence[str], order_by: str | Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[name(c) for c in names(partition_by)]).orderBy(*[name(c) for c in names(order_by)])


def value_changed(value: str | Column, w: WindowSpec, threshold: float = 0.0, change_at_nan: bool = True) -> Column:
    """True unless the value is within less than threshold of the one before. The first row, and with change_at_nan a missing value and the
    row after it, are changes. With the default threshold every row is one, as nothing is less than 0 apart."""
    v = no_nan(name(value) if isinstance(value, str) else value)
    before = F.lag(v).over(w)
    if not change_at_nan:
        before = F.last(v, ignorenulls=True).over(w.rowsBetween(FIRST, -1))
        v = F.last(v, ignorenulls=True).over(w.rowsBetween(FIRST, 0))
    return ~or_false(F.abs(v - before) < F.lit(threshold))


def id_changed(value: str | Column, w: WindowSpec, change_at_nan: bool = True) -> Column:
    """True unless the value equals the one before; missing values equal nothing. With change_at_nan=False they take the last value before them."""
    v = name(value) if isinstance(value, str) else value
    if change_at_nan:
        return or_true(v != F.lag(v).over(w))
    return or_true(F.last(v, ignorenulls=True).over(w.rowsBetween(FIRST, 0)) != F.last(v, ignorenulls=True).over(w.rowsBetween(FIRST, -1)))


def grouper(flags: Column, w: WindowSpec, start_id: int = 1) -> Column:
    """The number of the group that a row belongs to; each True starts one. Rows before the first True get start_id - 1."""
    return F.sum(or_false(flags).cast("long")).over(w.rowsBetween(FIRST, 0)) + F.lit(start_id - 1)


def group_row_number(keys: str | Sequence[str], order_by: str | Sequence[str], ascending: bool = True) -> Column:
    """Place in the group from 0, counted from its end if not ascending. Rows with a null key are one group."""
    w = ordered(keys, order_by)
    row = F.row_number().over(w)
    if ascending:
        return (row - 1).cast("long")
    return (F.count(F.lit(1)).over(Window.partitionBy(*[name(k) for k in names(keys)])) - row).cast("long")


def fbfill(value: str | Column, w: WindowSpec, limit: int | None = None) -> Column:
    """The value, or if missing the nearest one before or after, the one before at equal distance; at most limit rows away. In runs at either end, the half
    that is nearer to the edge stays missing."""
    v = name(value) if isinstance(value, str) else value
    up, down, whole = w.rowsBetween(FIRST, 0), w.rowsBetween(0, LAST), w.rowsBetween(FIRST, LAST)
    row = F.row_number().over(w)
    back = row - F.coalesce(F.last(F.when(v.isNotNull(), row), ignorenulls=True).over(up), F.lit(0))
    ahead = F.coalesce(F.first(F.when(v.isNotNull(), row), ignorenulls=True).over(down), F.count(F.lit(1)).over(whole) + 1) - row
    before, after = F.last(v, ignorenulls=True).over(up), F.first(v, ignorenulls=True).over(down)
    most = F.lit(limit if limit is not None else (1 << 31) - 1)
    return F.when(v.isNotNull(), v).when(back <= ahead, F.when(back <= most, before)).otherwise(F.when(ahead <= most, after))

"""Rows left out by label, and duplicates within an index value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.nulls import all_present, is_in, name, names, unused, without_nan

#: Labels up to which the filter is a predicate that reaches the scan; beyond, it's an anti-join with a local table of them.
INLINE = 1000


def drop_rows_by_index(df: DataFrame, index: str, labels: Sequence) -> DataFrame:
    """Rows whose index is not among labels. A null index stays unless None is among them."""
    labels = list(labels)
    if len(labels) <= INLINE:
        return df.where(~is_in(name(index), labels))
    label = unused(df, "label")
    some = df.sparkSession.createDataFrame([(v,) for v in labels if v is not None], df.select(name(index).alias(label)).schema)
    kept = df.join(some, name(index) == F.col(label), "left_anti")
    return kept.where(name(index).isNotNull()) if None in labels else kept


def drop_duplicates_by_index_and_keys(df: DataFrame, index: str | Sequence[str], subset: Sequence[str], order_by: Sequence[str], keep: str | bool = "first") -> DataFrame:
    """One row for each index value and subset value: the first or last by order_by, or with keep=False only those without a twin. Rows with a null index are left out; nulls in subset are equal."""
    index = names(index)
    w = Window.partitionBy(*[name(c) for c in [*index, *subset]])
    rows = without_nan(df, [*index, *subset]).where(all_present(index))
    n = unused(df, "n")
    if keep is False:
        return rows.withColumn(n, F.count(F.lit(1)).over(w)).where(F.col(n) == 1).drop(n)
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first', 'last' or False")
    order = [name(c).asc() if keep == "first" else name(c).desc() for c in order_by]
    return rows.withColumn(n, F.row_number().over(w.orderBy(*order))).where(F.col(n) == 1).drop(n)

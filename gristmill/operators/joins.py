"""Equi-joins that keep the index columns, with null keys equal and clashing names given suffixes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import name, names, same, without_nan

HOWS = ("inner", "left", "right", "outer")
#: Bytes, as Spark's planner estimates them without running anything, up to which a side is sent to every executor on request; a larger side is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def merge_keep_index(
    left: DataFrame, right: DataFrame, left_on: str | Sequence[str], right_on: str | Sequence[str], how: str = "inner", *, left_index: str | Sequence[str] = (), right_index: str | Sequence[str] = (),
    keep_left_index: bool = True, keep_right_index: bool = True, reindex_by_left: bool = True, reindex_by_right: bool = False, broadcast_right: bool = False, right_bytes: int | None = None,
) -> DataFrame:
    """left joined with right. The columns of the chosen index come first, then left's, then right's. An index that is not kept is dropped
    first. Key pairs of one name give one column; other names on both sides get _x and _y. broadcast_right: right is sent to all executors if right_bytes, or else its estimate, is small enough."""
    left_index, right_index, left_on, right_on = names(left_index), names(right_index), names(left_on), names(right_on)
    if how not in HOWS:
        raise ValueError(f"how is one of {HOWS}")
    if reindex_by_left == reindex_by_right:
        raise ValueError("exactly one of reindex_by_left and reindex_by_right must be set")
    if keep_left_index and keep_right_index and left_index == right_index:
        raise ValueError("both indexes are kept, so their names must differ")
    chosen = left_index if reindex_by_left else right_index
    if not chosen or keep_left_index and not left_index or keep_right_index and not right_index:
        raise ValueError("an index that is used must be named")
    lefts = [c for c in _order(left, left_index) if keep_left_index or c not in left_index]
    rights = [c for c in _order(right, right_index) if keep_right_index or c not in right_index]
    missing = [c for c in left_on if c not in lefts] + [c for c in right_on if c not in rights]
    if missing:
        raise ValueError(f"keys that are not there: {missing}")
    # places, not names: names may differ in case only
    a = without_nan(left, left_on).select(*[name(c).alias(f"l{k}") for k, c in enumerate(lefts)])
    b = without_nan(right, right_on).select(*[name(c).alias(f"r{k}") for k, c in enumerate(rights)])
    on = [(lefts.index(x), rights.index(y)) for x, y in zip(left_on, right_on, strict=True)]
    joined = a.join(F.broadcast(b) if broadcast_right and (estimated_bytes(b) if right_bytes is None else right_bytes) <= BROADCAST_BYTES else b, same([a[f"l{x}"] for x, _ in on], [b[f"r{y}"] for _, y in on]), how)
    shared = {(x, y) for x, y in on if lefts[x] == rights[y]}
    one = {y for _, y in shared}
    clash = (set(lefts) & {c for k, c in enumerate(rights) if k not in one}) - {lefts[x] for x, _ in shared}
    out = []
    for k, c in enumerate(lefts):
        other = next((y for x, y in shared if x == k), None)
        out.append((f"{c}_x" if c in clash else c, F.col(f"l{k}") if other is None else F.coalesce(f"l{k}", f"r{other}")))
    out += [(f"{c}_y" if c in clash else c, F.col(f"r{k}")) for k, c in enumerate(rights) if k not in one]
    first = [p for i in chosen for p in out if p[0] == i]
    if len(first) < len(chosen):
        raise ValueError("the index to reindex by is not in the result under its own name")
    final = [*first, *[p for p in out if p not in first]]
    return joined.select(*[c.alias(f"c{k}") for k, (_, c) in enumerate(final)]).toDF(*[n for n, _ in final])


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size, which for files is at least what their columns take and for filters and joins an upper bound in most cases."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _order(df: DataFrame, index: Sequence[str]) -> list[str]:
    return [*index, *[c for c in df.columns if c not in index]]


def merge_broadcast(left: DataFrame, right, left_on, right_on, how: str = "inner", **kwargs) -> DataFrame:
    """merge_keep_index() with a small right side: a DataFrame, a pandas frame, or a function without arguments that gives one. The right side is sent
    to all executors if its size, known of a pandas frame and estimated of a DataFrame, is BROADCAST_BYTES at most and how allows it; right and outer joins shuffle and
    give each unmatched row once. No job runs."""
    if isinstance(right, Callable) and not isinstance(right, DataFrame):
        right = right()
    if not isinstance(right, DataFrame):
        kwargs["right_bytes"] = int(right.memory_usage(deep=True).sum())
        right = left.sparkSession.createDataFrame(right)
    return merge_keep_index(left, right, left_on, right_on, how, broadcast_right=how in ("inner", "left"), **kwargs)

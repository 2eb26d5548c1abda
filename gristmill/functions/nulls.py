"""Missing values as one notion: NaN counts as null, predicates give False on null, null keys match each other."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name(c: str) -> Column:
    """The column of this name, whatever characters are in it."""
    return F.col("`" + c.replace("`", "``") + "`")


def names(cs: str | Sequence[str]) -> list[str]:
    return [cs] if isinstance(cs, str) else list(cs)


def unused(df: DataFrame, base: str) -> str:
    """A name that none of df's columns has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without_nan(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """df with NaN turned to null in the float and double columns given (default: all)."""
    kinds = dict(df.dtypes)
    wanted = [c for c in (df.columns if columns is None else columns) if kinds.get(c) in ("float", "double")]
    return df.withColumns({c: F.nanvl(name(c), F.lit(None).cast(kinds[c])) for c in wanted}) if wanted else df


def no_nan(c: Column) -> Column:
    """A numeric column as double, NaN as null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def or_false(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def or_true(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(True))


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [name(c).isNotNull() for c in columns], F.lit(True))


def is_in(c: Column, values: Sequence) -> Column:
    """Membership that is never null; None in values matches null."""
    some = [v for v in values if v is not None]
    found = or_false(c.isin(some)) if some else F.lit(False)
    return found | c.isNull() if len(some) < len(values) else found


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality of key lists in which null equals null; still an equi-join for the planner."""
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(left, right, strict=True)])

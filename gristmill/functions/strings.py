"""Predicates with many patterns, and numbers as text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import or_false


def _any(patterns: Sequence[str], test: Callable[[str], Column]) -> Column:
    """False on null and for no patterns."""
    return or_false(reduce(lambda a, b: a | b, map(test, patterns), F.lit(False)))


def startswith_many(c: Column, prefixes: Sequence[str]) -> Column:
    return _any(prefixes, c.startswith)


def endswith_many(c: Column, suffixes: Sequence[str]) -> Column:
    return _any(suffixes, c.endswith)


def contains_many(c: Column, patterns: Sequence[str], regex: bool = True) -> Column:
    """Any pattern found anywhere: Java regular expressions, or literal texts with regex=False."""
    return _any(patterns, c.rlike if regex else c.contains)


def as_text(c: Column, kind: str, keep_nan: bool = True, remove_dotzero: bool = False) -> Column:
    """c, of the given type name, as Python would print it. Missing stays null, or becomes 'nan' with keep_nan=False, and then
    nothing is removed. remove_dotzero strips a literal trailing '.0'."""
    if kind in ("float", "double"):
        shown = _float_text(c)
        missing = c.isNull() | F.isnan(c)
    else:
        shown = F.when(c, "True").otherwise("False") if kind == "boolean" else c.cast("string")
        missing = c.isNull()
    if not keep_nan:
        return F.when(missing, "nan").otherwise(shown)
    return F.when(~missing, F.regexp_replace(shown, r"\.0$", "") if remove_dotzero else shown)


def _float_text(c: Column) -> Column:
    """Shortest digits without exponent for 1e-4 <= |x| < 1e16, else as 1e+16 or 1e-05."""
    text = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    digits = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.try_element_at(F.split(text, "E"), F.lit(2)).try_cast("int")
    small = F.concat(digits, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    large = F.concat(digits, F.lit("e+"), F.abs(power).cast("string"))
    finite = F.when(power.isNull(), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.when(size >= 1e100, large).when(size < 1e-99, F.concat(digits, F.lit("e"), power.cast("string"))).otherwise(small))
    return F.when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(finite)

"""Lenient numbers: bad input becomes null instead of an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lenient_double(c: Column) -> Column:
    return c.try_cast("double")


def lenient_long(c: Column) -> Column:
    return c.try_cast("bigint")


def canonical_id(c: Column) -> Column:
    """One text for an id: whole numbers without fraction, other text trimmed."""
    number = c.cast("string").try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 9e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(F.trim(c.cast("string")))


def per_100m(count: Column, length_m: Column) -> Column:
    """Count per 100 m; 0 where the length is 0, null or not finite."""
    return F.coalesce(F.try_divide(100.0 * count, F.when(length_m < float("inf"), length_m)), F.lit(0.0))


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def row_sum(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)).cast("double") for c in columns], F.lit(0.0))


def half_even(c: Column) -> Column:
    return F.bround(c).cast("bigint")


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """Without rows that have a null or NaN in ``subset``."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float")}
    keep = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (~F.isnan(F.col(c)) if c in numeric else F.lit(True)) for c in subset])
    return df.filter(keep)

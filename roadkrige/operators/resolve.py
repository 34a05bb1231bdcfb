"""Driver-side resolution of column names; no job runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import POI_PREFIXES

# Names that are looked for, in this order.
ID_NAMES = ("osm_id", "osmid", "id", "road_id", "roadid")
VALUE_NAMES = ("aadt", "AADT", "aadt_value", "AADT_value", "value")
TYPE_NAMES = ("roadtype", "type", "highway", "type_level")
DENSITY_NAMES = ("road_density", "road_dens", "density")
LON_NAMES = ("coords_lon", "lon", "x", "longitude")
LAT_NAMES = ("coords_lat", "lat", "y", "latitude")


def find_id_key(left: Iterable[str], right: Iterable[str]) -> tuple[str, str]:
    """The id column of two tables, case ignored; else the alphabetically first shared column."""
    a, b = {c.lower(): c for c in left}, {c.lower(): c for c in right}
    shared = [n for n in ID_NAMES if n in a and n in b] or sorted(a.keys() & b.keys())
    if not shared:
        raise ValueError("the tables share no column that could be an id")
    return a[shared[0]], b[shared[0]]


def find_value_column(columns: list[str]) -> str:
    """The value column by name, case kept; else the last column."""
    return next((n for n in VALUE_NAMES if n in columns), columns[-1])


def find_first(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in columns), None)


def with_default(df: DataFrame, names: tuple[str, ...], to: str, default) -> DataFrame:
    """``to`` holds the first of ``names`` that exists, nulls and absence made ``default``."""
    found = find_first(df.columns, names)
    return df.withColumn(to, F.coalesce(F.col(found), F.lit(default)) if found else F.lit(default))


def find_lonlat(columns: list[str]) -> tuple[str | None, str | None]:
    """Longitude and latitude columns; the last that matches counts."""
    last = lambda names: next((c for c in reversed(columns) if c.lower() in names), None)
    return last(LON_NAMES), last(LAT_NAMES)


def poi_columns(columns: list[str], prefixes: tuple[str, ...] = POI_PREFIXES) -> list[str]:
    return [c for c in columns if c.startswith(prefixes)]


def in_order(*groups: Iterable[str]) -> list[str]:
    """All names once, in the order met."""
    return list(dict.fromkeys(n for g in groups for n in g))


def require_rows(df: DataFrame, least: int, what: str = "rows") -> int:
    """The number of rows; an error if there are fewer than ``least``."""
    n = df.count()
    if n < least:
        raise ValueError(f"{what}: {n} found, at least {least} needed")
    return n


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) & set(b.columns))


def tags_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))

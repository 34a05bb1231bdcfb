"""Text functions of traffic-count sheets and road names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Characters without width that are removed from names.
INVISIBLE = "​‌‍⁠﻿"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clean_text(c: Column) -> Column:
    """NFC, invisible characters removed, outer white space stripped, lower case; null stays null."""
    # plain ASCII is NFC already, so only other rows need Python
    composed = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(_nfc(F.when(F.octet_length(c) != F.char_length(c), c)))
    shown = F.translate(composed, INVISIBLE, "")
    return F.lower(F.regexp_replace(shown, r"(?U)^\s+|\s+$", ""))


def match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, or null (regexp_extract gives '' there)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def extract_latlon(c: Column) -> Column:
    """(lat, lon) of the first two unsigned decimals with a comma or space between them."""
    pattern = r"(\d+\.\d+)[,\s]+(\d+\.\d+)"
    return F.struct(match(c, pattern, 1).try_cast("double").alias("lat"), match(c, pattern, 2).try_cast("double").alias("lon"))


def anchored_latlon(c: Column) -> Column:
    """(lat, lon) of a text that holds two signed numbers and nothing else."""
    pattern = r"^\s*([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)\s*$"
    return F.struct(match(c, pattern, 1).try_cast("double").alias("lat"), match(c, pattern, 2).try_cast("double").alias("lon"))


def max_speed(c: Column) -> Column:
    """The first number in a text, as double."""
    return match(c, r"\d+\.?\d*").try_cast("double")


def max_speed_whole(c: Column) -> Column:
    """The first run of digits as double; 0 where there is none."""
    return F.coalesce(match(c, r"\d+").try_cast("double"), F.lit(0.0))


def digits_id(c: Column) -> Column:
    """The digits of an identifier such as ``way/123``."""
    return match(c, r"\d+").try_cast("bigint")


def file_date(c: Column) -> Column:
    """yyyy-mm-dd or yyyy_mm_dd in a file name, kept as text."""
    return match(c, r"\d{4}[-_]\d{2}[-_]\d{2}")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def match_key(*columns) -> Column:
    """Text key of several columns; null parts count as ''."""
    return F.concat(*[x for i, c in enumerate(columns) for x in ([F.lit("_")] * (i > 0) + [F.coalesce(F.col(c).cast("string"), F.lit(""))])])


def common_length(masks: dict[str, int], n: int, window: str) -> int:
    """Length of the longest common subsequence of a text of n characters, given as the bits at which each stands, and a window.

    A bit that has become 0 marks a character that is matched; all bits of a
    step are worked out by one addition.
    """
    full = row = (1 << n) - 1
    for x in window:
        met = row & masks.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return n - row.bit_count()


def best_window_ratio(a: str | None, b: str | None) -> float | None:
    """The best ratio, 100 (1 - insertions and deletions / total length), of the shorter text against any stretch of the longer one."""
    if a is None or b is None:
        return None
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, masks = len(short), {}
    for i, x in enumerate(short):
        masks[x] = masks.get(x, 0) | 1 << i
    best = 0.0
    # stretches that start or end with a character that matches nothing are never better
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        most = 200.0 * min(n, len(window)) / (n + len(window))
        if most > best and (window[-1] in masks or window[0] in masks):
            best = max(best, 200.0 * common_length(masks, n, window) / (n + len(window)))
    return best


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Fuzzy containment score, 0 to 100; each distinct pair of a batch is scored once."""
    known: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = best_window_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")

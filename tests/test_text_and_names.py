from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roadkrige.functions import classify as C
from roadkrige.functions import numbers as N
from roadkrige.functions import text as T
from roadkrige.operators import resolve as R


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    assert each(spark, ["  Ab​C \n", "é", " x ", None, "﻿", "ÉTÉ"], T.clean_text) == ["abc", "é", "x", None, "", "été"]


def test_places(spark):
    assert [tuple(p) for p in each(spark, ["a 13.5, 100.25 b", "13,100", None, "1.0 2.0 3.0"], T.extract_latlon)] == [(13.5, 100.25), (None, None), (None, None), (1.0, 2.0)]
    assert [tuple(p) for p in each(spark, [" -13.5 , 100 ", "13.5 100.2", "x 1,2", None], T.anchored_latlon)] == [(-13.5, 100.0), (None, None), (None, None), (None, None)]


def test_numbers(spark):
    assert each(spark, ["50 km/h", "30.5;40", "none", None], T.max_speed) == [50.0, 30.5, None, None]
    assert each(spark, ["50 km/h", "x", None], T.max_speed_whole) == [50.0, 0.0, 0.0]
    assert each(spark, ["way/77", "node", None, "9" * 30], T.digits_id) == [77, None, None, None]
    assert each(spark, ["a_2024-01-02.xlsx", "2023_12_31", "20240101"], T.file_date) == ["2024-01-02", "2023_12_31", None]
    assert each(spark, ["123.0", " 123 ", "a1 ", None], N.canonical_id) == ["123", "123", "a1", None]
    assert each(spark, [0.5, 1.5, 2.5, None], N.half_even, "double") == [0, 2, 2, None]
    assert each(spark, [0.0, None, float("inf"), 50.0], lambda m: N.per_100m(F.lit(2), m), "double") == [0.0, 0.0, 0.0, 4.0]


@pytest.mark.parametrize("a,b,want", [("road", "main road x", 100.0), ("abcd", "abxd", 75.0), ("", "", 100.0), ("", "a", 0.0), ("abc", "xyz", 0.0), ("ab", "ba", 100 * 2 / 3), (None, "a", None)])
def test_fuzzy(a, b, want):
    got = T.best_window_ratio(a, b)
    assert got is want if want is None else got == pytest.approx(want)


def test_classes(spark):
    tags = [("cafe", None, None), ("bank", "x", None), (None, "NaN", None), (" Bus_Stop ", "x", None), (None, None, "halt"), ("nothing", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tags)], "i int, amenity string, shop string, railway string")
    got = [r.c for r in df.select("i", C.poi_class(df.columns).alias("c")).orderBy("i").collect()]
    assert got == ["food", "retail", "other", "transport", "transport", "other", "other"]
    assert each(spark, ["primary_link", "path", None], C.road_level) == ["Level_1", "Level_4", "Level_4"]
    assert each(spark, ["dens300_x", "type_a", "population", "zz"], C.feature_family) == ["poi_density", "roadtype(onehot)", "population", "other"]


def test_resolution(spark):
    assert R.find_id_key(["a", "OSM_ID"], ["osm_id", "id"]) == ("OSM_ID", "osm_id")
    assert R.find_id_key(["b", "z", "a"], ["z", "A"]) == ("a", "A")
    with pytest.raises(ValueError):
        R.find_id_key(["a"], ["b"])
    assert R.find_value_column(["x", "AADT", "y"]) == "AADT" and R.find_value_column(["x", "y"]) == "y"
    assert R.find_lonlat(["lon", "x", "LAT"]) == ("x", "LAT")
    assert R.poi_columns(["dist_a", "x", "entropy_b"]) == ["dist_a", "entropy_b"] and R.in_order("ab", "bc") == ["a", "b", "c"]
    df = spark.range(3)
    assert R.require_rows(df, 3) == 3
    with pytest.raises(ValueError):
        R.require_rows(df, 4)
    assert R.with_default(df, ("type",), "kind", "unknown").first().kind == "unknown"


def test_bit_parallel_score_equals_the_plain_one():
    import random

    def plain(a, b):
        short, long = sorted((a, b), key=len)
        best = 0.0
        for start in range(1 - len(short), len(long)):
            window = long[max(0, start) : start + len(short)]
            row = [0] * (len(window) + 1)
            for x in short:
                last = 0
                for j, y in enumerate(window, 1):
                    last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
            best = max(best, 200.0 * row[-1] / (len(short) + len(window)))
        return best

    random.seed(4)
    for _ in range(400):
        a, b = ("".join(random.choice("abcd é") for _ in range(random.randint(1, n))) for n in (12, 90))
        assert T.best_window_ratio(a, b) == plain(a, b)

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadkrige.functions import geometry as G
from roadkrige.functions import projections as P
from roadkrige.operators import features
from roadkrige.sources import files, geotiff

CLARKE = P.Ellipsoid(6378206.4, 1 / 294.9786982)
FOOT = 1200 / 3937


def degrees(d, m=0, s=0.0):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)


# worked examples of the registry's guidance on coordinate operations, printed to the centimetre
PUBLISHED = {
    "mercator, scale": (P.Projection("mercator", P.Ellipsoid(6377397.155, 1 / 299.15281), 110, k=0.997, east=3900000, north=900000), 120, -3, 5009726.58, 569150.82),
    "mercator, parallel": (P.Projection("mercator", P.Ellipsoid(6378245.0, 1 / 298.3), 51, lat1=42), 53, 53, 165704.29, 5171848.07),
    "mercator, web": (P.WEB_MERCATOR, degrees(-100, 20), degrees(24, 22, 54.433), -11169055.58, 2800000.00),
    "cone, two parallels": (P.Projection("conformal_conic", CLARKE, -99, degrees(27, 50), degrees(28, 23), degrees(30, 17), east=2000000 * FOOT), -96, 28.5, 2963503.91 * FOOT, 254759.80 * FOOT),
    "cone, one parallel": (P.Projection("conformal_conic", CLARKE, -77, 18, east=250000, north=150000), degrees(-76, 56, 37.26), degrees(17, 55, 55.80), 255966.58, 142493.51),
    "transverse": (P.Projection("transverse", P.Ellipsoid(6377563.396, 1 / 299.32496), -2, 49, k=0.9996012717, east=400000, north=-100000), 0.5, 50.5, 577274.99, 69740.50),
}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_published_points(spark):
    got = one(spark, **{n: p.forward(float(lon), float(lat)) for n, (p, lon, lat, *_) in PUBLISHED.items()})
    back = one(spark, **{n: p.inverse(F.lit(x), F.lit(y)) for n, (p, _, _, x, y) in PUBLISHED.items()})
    for n, (_, lon, lat, x, y) in PUBLISHED.items():
        assert (got[n].x, got[n].y) == pytest.approx((x, y), abs=0.011), n
        assert (back[n].x, back[n].y) == pytest.approx((lon, lat), abs=1.5e-7), n


def test_albers_keeps_areas_and_its_published_point(spark):
    p = P.Projection("albers", P.Ellipsoid(6378206.4, 1 / 294.9786982), -96, 23, 29.5, 45.5)
    step = 1e-4
    row = one(spark, at=p.forward(-75.0, 35.0), **{f"c{i}": p.forward(-80.0 + dx, 40.0 + dy) for i, (dx, dy) in enumerate([(0, 0), (step, 0), (step, step), (0, step)])})
    assert (row["at"].x, row["at"].y) == pytest.approx((1885472.7, 1535925.0), abs=0.06)
    c = [row[f"c{i}"] for i in range(4)]
    area = sum(a.x * b.y - b.x * a.y for a, b in zip(c, c[1:] + c[:1], strict=True)) / 2
    el = p.ellipsoid
    true = el.a**2 * np.radians(step) * float(P._q(np.radians(40 + step), el) - P._q(np.radians(40), el)) / 2
    assert area == pytest.approx(true, rel=1e-5)


def test_shift_published(spark):
    shift = P.Shift(z=4.5, rz=0.554, ppm=0.219)
    at = [F.lit(v) for v in (3657660.66, 255768.55, 5201382.11)]
    there = shift.to_wgs84(*at)
    row = one(spark, **{f"t{i}": c for i, c in enumerate(there)}, **{f"b{i}": c for i, c in enumerate(shift.from_wgs84(*there))})
    assert [row[f"t{i}"] for i in range(3)] == pytest.approx([3657660.78, 255778.43, 5201387.75], abs=0.006)
    assert [row[f"b{i}"] for i in range(3)] == pytest.approx([3657660.66, 255768.55, 5201382.11], abs=1e-6)


HOME = {4326: (100.5, 13.75), 4269: (-90.0, 40.0), 4240: (100.5, 13.75), 4277: (-1.5, 52.0), 3395: (20.0, -40.0), 2154: (2.0, 47.0), 3577: (140.0, -25.0), 5070: (-90.0, 40.0), 27700: (-1.5, 52.0),
        24047: (100.5, 13.75), 24048: (104.0, 15.0), 3857: (179.5, 60.0), 32647: (97.5, 80.0), 32701: (-177.0, -33.0)}


def test_every_system_there_and_back(spark):
    out = {str(e): P.transform(F.lit(lon), F.lit(lat), 4326, e) for e, (lon, lat) in HOME.items()}
    # a step names its input once, so trees stay small however many steps there are
    assert max(len(str(c)) for c in out.values()) < 20_000
    there = one(spark, **out)
    back = one(spark, **{str(e): P.transform(F.lit(there[str(e)].x), F.lit(there[str(e)].y), e, 4326) for e in HOME})
    for e, at in HOME.items():
        shift = P.system(e)[1]
        if shift is None:  # a hundredth of a millimetre
            assert (back[str(e)].x, back[str(e)].y) == pytest.approx(at, abs=1e-10), e
            continue
        # a shift brings a height, which a point in the plane drops: the way back is off by the height times the angle between the normals
        el, lam, phi = P.system(e)[0].ellipsoid, *np.radians(at)
        n = P.WGS84.a / np.sqrt(1 - P.WGS84.e2 * np.sin(phi) ** 2)
        row = one(spark, **{c: v for c, v in zip("xyz", shift.from_wgs84(*[F.lit(float(v)) for v in (n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - P.WGS84.e2) * np.sin(phi))]), strict=True)})
        there_geo = P.geodetic(F.lit(row.x), F.lit(row.y), F.lit(row.z), el)
        g = one(spark, g=there_geo).g
        m = el.a / np.sqrt(1 - el.e2 * np.sin(np.radians(g.y)) ** 2)
        height = abs(np.hypot(row.x, row.y) / np.cos(np.radians(g.y)) - m)
        bound = height * np.hypot(*np.subtract((g.x, g.y), at)) / m * 1.2 + 1e-10
        assert height < 100 and bound < 1e-7 and np.hypot(*np.subtract((back[str(e)].x, back[str(e)].y), at)) < bound, e
    with pytest.raises(ValueError):
        P.system(1)


def test_utm_is_the_series_of_the_library(spark):
    for lon, lat in ((100.5, 13.75), (97.1, 20.0), (101.9, -5.5)):
        row = one(spark, a=P.transform(F.lit(lon), F.lit(lat), 4326, 32647), b=G.utm_forward(lon, lat))
        assert (row.a.x, row.a.y) == pytest.approx((row.b.x, row.b.y), abs=1e-3)


def test_nulls_poles_and_the_date_line(spark):
    null = F.lit(None).cast("double")
    row = one(spark, n=P.transform(null, F.lit(1.0), 4326, 3395), pole=P.WEB_MERCATOR.forward(0.0, 90.0), beyond=P.SYSTEMS[2154][0].forward(3.0, 91.0), top=P.SYSTEMS[2154][0].forward(3.0, 90.0),
              west=P.transform(F.lit(-179.0), F.lit(-33.0), 4326, 32760), east=P.transform(F.lit(181.0), F.lit(-33.0), 4326, 32760))
    assert row.n.x is None and row.pole.y is None and row.beyond.y is None
    assert row.top.x == pytest.approx(700000) and row.west == pytest.approx(row.east)


def test_raster_in_its_own_system(spark, tmp_path):
    band = np.arange(40.0).reshape(5, 8)
    band[0, 0] = -1
    files.write_bytes(spark, f"{tmp_path}/d.tif", geotiff.geotiff(band, 100.0, 14.0, 0.01, -1.0, epsg=4326))
    info = geotiff.raster_info(spark, f"{tmp_path}/d.tif").first()
    assert info.epsg == 4326
    places = [(1, 100.005, 13.995), (2, 100.075, 13.955), (3, 100.034, 13.972), (4, 99.9, 13.9), (5, None, None)]
    points = spark.createDataFrame(places, "k int, lon double, lat double").withColumn("p", P.transform("lon", "lat", 4326, 32647)).select("k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    got = {r.k: r.value for r in features.raster_value(points, geotiff.read_geotiff(spark, f"{tmp_path}/d.tif"), info, 32647).collect()}
    assert got == {1: None, 2: 39.0, 3: 19.0, 4: None, 5: None}

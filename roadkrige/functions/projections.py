"""Map projections and datum shifts as Column expressions: everything stays in the JVM.

All projections rest on one of three auxiliary latitudes: conformal (Mercator,
transverse Mercator, Lambert's conic), authalic (Albers) and rectifying
(transverse Mercator).  What takes one into another is an odd function with a
fast sine series; its coefficients are computed for the ellipsoid at hand, to
double precision, when the expression is built.  Nulls give nulls; so does a
latitude beyond the poles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _col, point

_TERMS = 8


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float = 0.0

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


def _isometric(phi, e):
    return np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi))


def _conformal(phi, el: Ellipsoid):
    return np.arctan(np.sinh(_isometric(phi, el.e)))


def _q(phi, el: Ellipsoid):
    s = np.sin(phi)
    return 2 * s if not el.f else (1 - el.e2) * (s / (1 - el.e2 * s * s) + np.arctanh(el.e * s) / el.e)


def _authalic(phi, el: Ellipsoid):
    return np.arcsin(_q(phi, el) / _q(np.pi / 2, el))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def _arc(phi, el: Ellipsoid):
    """The meridian from the equator, over the major axis."""
    at = np.asarray(phi)[..., None] * (_NODES + 1) / 2
    return np.asarray(phi) / 2 * np.sum(_WEIGHTS * (1 - el.e2) / (1 - el.e2 * np.sin(at) ** 2) ** 1.5, axis=-1)


def _rectifying(phi, el: Ellipsoid):
    return np.pi / 2 * _arc(phi, el) / _arc(np.pi / 2, el)


_LATITUDES = {"geodetic": lambda phi, el: phi, "conformal": _conformal, "authalic": _authalic, "rectifying": _rectifying}


@cache
def _series(source: str, target: str, el: Ellipsoid) -> tuple[float, ...]:
    """c with target = source + sum of c[k] sin(2 k source), k from 1."""
    n = 64
    at = (np.arange(n) + 0.5) * np.pi / n - np.pi / 2
    phi = at.copy()
    for _ in range(12):  # the geodetic latitude at which the source has these values; each step gains two digits
        phi = phi + at - _LATITUDES[source](phi, el)
    gain = _LATITUDES[target](phi, el) - at
    return tuple(float(2 / n * np.sum(gain * np.sin(2 * k * at))) for k in range(1, _TERMS + 1))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: expressions that name their input twice would double at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(angle: Column, c: tuple[float, ...]) -> Column:
    """angle + sum of c[k] sin(2 k angle)."""
    return sum((v * F.sin(2 * k * angle) for k, v in enumerate(c, 1) if abs(v) > 1e-17), angle)


def _complex_sum(u: Column, v: Column, c: tuple[float, ...]) -> tuple[Column, Column]:
    """The same of a complex angle, real and imaginary part."""
    terms = [(2 * k, a) for k, a in enumerate(c, 1) if abs(a) > 1e-17]
    return sum((a * F.sin(k * u) * F.cosh(k * v) for k, a in terms), u), sum((a * F.cos(k * u) * F.sinh(k * v) for k, a in terms), v)


def _psi(phi: Column, e: float) -> Column:
    s = F.sin(phi)
    return F.atanh(s) - e * F.atanh(e * s) if e else F.atanh(s)


def _m(phi: float, el: Ellipsoid) -> float:
    return math.cos(phi) / math.sqrt(1 - el.e2 * math.sin(phi) ** 2)


@dataclass(frozen=True)
class Projection:
    """``kind``: geographic, mercator, transverse, conformal_conic or albers; angles in degrees.

    A Mercator with ``lat1`` is true to scale there; a conformal cone with one
    parallel has it in ``lat0`` and its scale in ``k``.
    """

    kind: str
    ellipsoid: Ellipsoid
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float | None = None
    lat2: float | None = None
    k: float = 1.0
    east: float = 0.0
    north: float = 0.0

    def _cone(self) -> tuple[float, float, float]:
        """Exponent, factor and radius at the origin of a cone."""
        el, r = self.ellipsoid, math.radians
        lat0, lat1 = r(self.lat0), r(self.lat0 if self.lat1 is None else self.lat1)
        lat2 = lat1 if self.lat2 is None else r(self.lat2)
        if self.kind == "albers":
            same = math.isclose(lat1, lat2)
            n = math.sin(lat1) if same else (_m(lat1, el) ** 2 - _m(lat2, el) ** 2) / float(_q(lat2, el) - _q(lat1, el))
            c = _m(lat1, el) ** 2 + n * float(_q(lat1, el))
            return n, c, el.a * math.sqrt(c - n * float(_q(lat0, el))) / n
        psi = lambda p: float(_isometric(p, el.e))
        n = math.sin(lat1) if math.isclose(lat1, lat2) else (math.log(_m(lat1, el)) - math.log(_m(lat2, el))) / (psi(lat2) - psi(lat1))
        factor = el.a * self.k * _m(lat1, el) * math.exp(n * psi(lat1)) / n
        return n, factor, factor * math.exp(-n * psi(lat0))

    def _scale(self) -> float:
        el = self.ellipsoid
        if self.kind == "mercator":
            return el.a * (self.k if self.lat1 is None else _m(math.radians(self.lat1), el))
        return el.a * self.k * 2 / math.pi * float(_arc(np.pi / 2, el))

    def forward(self, lon, lat) -> Column:
        """Degrees to metres, as a point."""
        lon, lat = _col(lon), _col(lat)
        if self.kind == "geographic":
            return point(lon, lat)
        el = self.ellipsoid
        # the poles themselves have no place in a Mercator
        fits = F.abs(lat) < 90 if self.kind == "mercator" else F.abs(lat) <= 90
        angles = point(F.radians(F.pmod(lon - self.lon0 + 180.0, F.lit(360.0)) - 180.0), F.when(fits, F.radians(lat)))
        if self.kind == "mercator":
            return _let(angles, lambda p: point(self.east + self._scale() * p["x"], self.north + self._scale() * _psi(p["y"], el.e)))
        if self.kind == "transverse":
            origin = float(_rectifying(math.radians(self.lat0), el))

            def sphere(p: Column) -> Column:
                return _let(F.sinh(_psi(p["y"], el.e)), lambda t: point(F.atanh(F.sin(p["x"]) / F.sqrt(1 + t * t)), F.atan2(t, F.cos(p["x"]))))

            def plane(p: Column) -> Column:
                y, x = _complex_sum(p["y"], p["x"], _series("conformal", "rectifying", el))
                return point(self.east + self._scale() * x, self.north + self._scale() * (y - origin))

            return _let(_let(angles, sphere), plane)
        n, factor, r0 = self._cone()

        def polar(p: Column) -> Column:
            s = F.sin(p["y"])
            if self.kind == "albers":
                q = 2 * s if not el.f else (1 - el.e2) * (s / (1 - el.e2 * s * s) + F.atanh(el.e * s) / el.e)
                # greatest would pass over a null
                r = el.a / n * F.sqrt(F.when(factor - n * q > 0, factor - n * q).when(p["y"].isNotNull(), 0.0))
            else:
                r = factor * F.exp(-n * _psi(p["y"], el.e))
            return point(r, n * p["x"])

        return _let(_let(angles, polar), lambda p: point(self.east + p["x"] * F.sin(p["y"]), self.north + r0 - p["x"] * F.cos(p["y"])))

    def inverse(self, x, y) -> Column:
        """Metres to degrees, as a point (x: longitude, y: latitude)."""
        x, y = _col(x), _col(y)
        if self.kind == "geographic":
            return point(x, y)
        el = self.ellipsoid
        series = _series("authalic" if self.kind == "albers" else "conformal", "geodetic", el)

        def sphere(p: Column) -> Column:
            """Longitude from the centre, and the auxiliary latitude."""
            dx, dy = p["x"], p["y"]
            if self.kind == "mercator":
                return point(dx / self._scale(), F.atan(F.sinh(dy / self._scale())))
            if self.kind == "transverse":
                origin = float(_rectifying(math.radians(self.lat0), el))
                u, v = _complex_sum(dy / self._scale() + origin, dx / self._scale(), _series("rectifying", "conformal", el))
                return _let(point(u, v), lambda w: point(F.atan2(F.sinh(w["y"]), F.cos(w["x"])), F.asin(F.sin(w["x"]) / F.cosh(w["y"]))))
            n, factor, r0 = self._cone()
            sign = math.copysign(1.0, n)
            r = F.hypot(dx, r0 - dy)
            if self.kind == "albers":
                sine = (factor - (r * n / el.a) ** 2) / n / float(_q(np.pi / 2, el))
                # a hair beyond the pole is the pole
                aux = _let(sine, lambda s: F.asin(F.when(F.abs(s) > 1, F.signum(s)).otherwise(s)))
            else:
                aux = F.atan(F.sinh(-F.log(r / abs(factor)) / n))
            return point(F.atan2(sign * dx, sign * (r0 - dy)) / n, aux)

        def degrees(p: Column) -> Column:
            return point(F.pmod(F.degrees(p["x"]) + self.lon0 + 180.0, F.lit(360.0)) - 180.0, F.degrees(_sum(p["y"], series)))

        return _let(_let(point(x - self.east, y - self.north), sphere), degrees)


@dataclass(frozen=True)
class Shift:
    """Seven parameters to WGS 84, rotations as of a position vector: metres, seconds of arc, parts per million."""

    x: float = 0.0
    y: float = 0.0
    z: float = 0.0
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0

    def to_wgs84(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        rx, ry, rz = (math.radians(v / 3600) for v in (self.rx, self.ry, self.rz))
        s = 1 + self.ppm * 1e-6
        return self.x + s * (x - rz * y + ry * z), self.y + s * (rz * x + y - rx * z), self.z + s * (-ry * x + rx * y + z)

    def from_wgs84(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """The exact inverse: the matrix is inverted, not its signs turned."""
        rx, ry, rz = (math.radians(v / 3600) for v in (self.rx, self.ry, self.rz))
        back = np.linalg.inv((1 + self.ppm * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]))
        x, y, z = x - self.x, y - self.y, z - self.z
        return tuple(float(a) * x + float(b) * y + float(c) * z for a, b, c in back)


def geocentric(lon: Column, lat: Column, el: Ellipsoid) -> tuple[Column, Column, Column]:
    """Earth-centred metres of a point on the ellipsoid."""
    lam, phi = F.radians(lon), F.radians(lat)
    n = el.a / F.sqrt(1 - el.e2 * F.sin(phi) ** 2)
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - el.e2) * F.sin(phi)


def geodetic(x: Column, y: Column, z: Column, el: Ellipsoid) -> Column:
    """Degrees; the height is left out.  Bowring's closed form, exact to a micrometre near the ground."""
    b = el.a * (1 - el.f)
    p = F.hypot(x, y)
    theta = F.atan2(z * el.a, p * b)
    phi = F.atan2(z + el.e2 / (1 - el.e2) * b * F.sin(theta) ** 3, p - el.e2 * el.a * F.cos(theta) ** 3)
    return point(F.degrees(F.atan2(y, x)), F.degrees(phi))


# Ellipsoids, datums and systems as their registries define them.
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
SPHERE = Ellipsoid(6378137.0)
EVEREST_1937 = Ellipsoid(6377276.345, 1 / 300.8017)
AIRY = Ellipsoid(6377563.396, 1 / 299.3249646)
INDIAN_1975 = Shift(210.0, 814.0, 289.0)
OSGB36 = Shift(446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
SYSTEMS: dict[int, tuple[Projection, Shift | None]] = {
    4326: (Projection("geographic", WGS84), None),
    4269: (Projection("geographic", GRS80), None),
    4240: (Projection("geographic", EVEREST_1937), INDIAN_1975),
    4277: (Projection("geographic", AIRY), OSGB36),
    3395: (Projection("mercator", WGS84), None),
    2154: (Projection("conformal_conic", GRS80, 3, 46.5, 49, 44, east=700000, north=6600000), None),
    3577: (Projection("albers", GRS80, 132, 0, -18, -36), None),
    5070: (Projection("albers", GRS80, -96, 23, 29.5, 45.5), None),
    27700: (Projection("transverse", AIRY, -2, 49, k=0.9996012717, east=400000, north=-100000), OSGB36),
    24047: (Projection("transverse", EVEREST_1937, 99, k=0.9996, east=500000), INDIAN_1975),
    24048: (Projection("transverse", EVEREST_1937, 105, k=0.9996, east=500000), INDIAN_1975),
}
WEB_MERCATOR = Projection("mercator", SPHERE)


def system(epsg: int) -> tuple[Projection, Shift | None]:
    """The projection of a code and the shift of its datum (None: taken as WGS 84)."""
    if epsg in SYSTEMS:
        return SYSTEMS[epsg]
    if epsg == 3857:  # a sphere's formula on WGS 84 latitudes
        return WEB_MERCATOR, None
    zone, base = epsg % 100, epsg // 100
    if base in (326, 327) and 1 <= zone <= 60:
        return Projection("transverse", WGS84, 6 * zone - 183, k=0.9996, east=500000, north=10_000_000 if base == 327 else 0), None
    raise ValueError(f"EPSG:{epsg} is not in the table")


def transform(x, y, source: int, target: int) -> Column:
    """A point of one system in another; x is the easting or longitude.

    Points have no height.  Between datums the height that a shift brings is
    dropped, so there and back may differ by up to a centimetre.
    """
    if source == target:
        return point(x, y)
    (one, away), (other, back) = system(source), system(target)
    p = one.inverse(x, y)

    def shifted(p: Column, el: Ellipsoid, move, to: Ellipsoid) -> Column:
        place = lambda c: F.struct(*[v.alias(n) for v, n in zip(c, "xyz", strict=True)])
        centred = _let(p, lambda q: place(geocentric(q["x"], q["y"], el)))
        moved = _let(centred, lambda c: place(move(c["x"], c["y"], c["z"])))
        return _let(moved, lambda c: geodetic(c["x"], c["y"], c["z"], to))

    if away != back:
        if away:
            p = shifted(p, one.ellipsoid, away.to_wgs84, WGS84)
        if back:
            p = shifted(p, WGS84, back.from_wgs84, other.ellipsoid)
    return _let(p, lambda q: other.forward(q["x"], q["y"]))

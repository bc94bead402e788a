"""Projected coordinates as column expressions: transverse Mercator by Krueger's series (sixth order), and web Mercator.

The forward map goes through the exact isometric latitude, the way back through the series of the conformal one, so neither
iterates.  Steps are columns of their own, which Catalyst does not fold into each other where one is used several times.
Rows outside the series' domain (within about 8 degrees of the equator's points that lie 90 degrees from the central
meridian) get nulls; so do null and non-finite inputs.  Filter by longitude and latitude before, or write the result: Catalyst
moves a filter on projected columns below the steps and repeats them there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction as Q
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.functions.scalars import WGS84_A, WGS84_F

#: Inverse flattening of the ellipsoid that most national systems share (fixed value).
GRS80_INVERSE_FLATTENING = 298.257222101

# The published coefficients of the series in the third flattening n; row j belongs to the angle 2j and
# starts at the power n^j.  TO_GRID: conformal sphere to grid; FROM_GRID: back; TO_GEODETIC: conformal to geodetic latitude.
TO_GRID = (
    (Q(1, 2), Q(-2, 3), Q(5, 16), Q(41, 180), Q(-127, 288), Q(7891, 37800)),
    (Q(13, 48), Q(-3, 5), Q(557, 1440), Q(281, 630), Q(-1983433, 1935360)),
    (Q(61, 240), Q(-103, 140), Q(15061, 26880), Q(167603, 181440)),
    (Q(49561, 161280), Q(-179, 168), Q(6601661, 7257600)),
    (Q(34729, 80640), Q(-3418889, 1995840)),
    (Q(212378941, 319334400),),
)
FROM_GRID = (
    (Q(1, 2), Q(-2, 3), Q(37, 96), Q(-1, 360), Q(-81, 512), Q(96199, 604800)),
    (Q(1, 48), Q(1, 15), Q(-437, 1440), Q(46, 105), Q(-1118711, 3870720)),
    (Q(17, 480), Q(-37, 840), Q(-209, 4480), Q(5569, 90720)),
    (Q(4397, 161280), Q(-11, 504), Q(-830251, 7257600)),
    (Q(4583, 161280), Q(-108847, 3991680)),
    (Q(20648693, 638668800),),
)
TO_GEODETIC = (
    (Q(2), Q(-2, 3), Q(-2), Q(116, 45), Q(26, 45), Q(-2854, 675)),
    (Q(7, 3), Q(-8, 5), Q(-227, 45), Q(2704, 315), Q(2323, 945)),
    (Q(56, 15), Q(-136, 35), Q(-1262, 105), Q(73814, 2835)),
    (Q(4279, 630), Q(-332, 35), Q(-399572, 14175)),
    (Q(4174, 315), Q(-144838, 6237)),
    (Q(601676, 22275),),
)

#: Largest ordinate on the conformal sphere at which the series is used (fixed value).
DOMAIN = 2.623395162778


@dataclass(frozen=True)
class Projection:
    """A metric grid.  ``kind`` is ``tm`` or ``web``; ``lon0`` is in degrees, or a column of them for a zone in each row."""

    kind: str
    lon0: float | Column = 0.0
    scale: float = 1.0
    false_east: float | Column = 0.0
    false_north: float | Column = 0.0
    inverse_flattening: float = 1.0 / WGS84_F
    radius: float = WGS84_A

    @property
    def third(self) -> float:
        f = 1.0 / self.inverse_flattening
        return f / (2.0 - f)

    @property
    def eccentricity(self) -> float:
        f = 1.0 / self.inverse_flattening
        return (f * (2.0 - f)) ** 0.5

    @property
    def rectifying(self) -> float:
        """Radius of the circle as long as a meridian, times the scale."""
        n = self.third
        return self.scale * self.radius / (1.0 + n) * (1.0 + n**2 / 4.0 + n**4 / 64.0 + n**6 / 256.0)


def series(rows: tuple, n: float) -> list[float]:
    return [sum(float(c) * n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


def _gauss(zone: int, width: int, numbered: bool) -> Projection:
    centre = zone * 3.0 if width == 3 else zone * 6.0 - 3.0
    return Projection("tm", centre, 1.0, 500000.0 + (zone * 1e6 if numbered else 0.0), 0.0, GRS80_INVERSE_FLATTENING)


def projection(crs: str) -> Projection:
    """The grid named by an EPSG code, with or without ``EPSG:``.

    Known are UTM on WGS 84 (32601-32660, 32701-32760) and on ETRS89 (25828-25838), the CGCS2000 zones of six and three degrees,
    with and without the zone's number in the easting (4491-4554), and web Mercator (3857).  Geographic systems are refused, as
    their units are no metres, and so is every code that is not known.
    """
    m = re.fullmatch(r"(?:EPSG:+)?(\d+)", str(crs).strip(), re.IGNORECASE)
    if not m:
        raise ValueError(f"unknown coordinate system {crs!r}")
    code = int(m[1])
    if code in (4326, 4979, 4490, 4258):
        raise ValueError("a geographic system has no metric coordinates")
    if code == 3857:
        return Projection("web")
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return Projection("tm", (code % 100) * 6.0 - 183.0, 0.9996, 500000.0, 1e7 if code > 32700 else 0.0)
    if 25828 <= code <= 25838:
        return Projection("tm", (code - 25800) * 6.0 - 183.0, 0.9996, 500000.0, 0.0, GRS80_INVERSE_FLATTENING)
    for first, zone, last, width, numbered in ((4491, 13, 23, 6, True), (4502, 13, 23, 6, False), (4513, 25, 45, 3, True), (4534, 25, 45, 3, False)):
        if first <= code <= first + last - zone:
            return _gauss(zone + code - first, width, numbered)
    raise ValueError(f"unknown coordinate system {crs!r}")


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone number, with the wider zones of south-west Norway and of Svalbard; longitude 180 belongs to zone 1."""
    plain = (F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 6.0) + 1).cast("int")
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42)
    return F.when(norway, 32).when(svalbard, F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)).otherwise(plain)


def utm(zone: Column, south: Column) -> Projection:
    """Each row's own UTM zone on WGS 84."""
    return Projection("tm", zone * 6.0 - 183.0, 0.9996, 500000.0, F.when(south, 1e7).otherwise(0.0))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _degrees_apart(lon: Column, lon0) -> Column:
    """Longitude from the central meridian, within 180 degrees of it."""
    return F.pmod(lon - _lit(lon0) + 180.0, F.lit(360.0)) - 180.0


def _waves(coefficients: list[float], a: str, b: str) -> tuple[Column, Column]:
    """Sums of c_j sin(2ja) cosh(2jb) and of c_j cos(2ja) sinh(2jb)."""
    terms = [(c, 2.0 * j * F.col(a), 2.0 * j * F.col(b)) for j, c in enumerate(coefficients, 1)]
    add = lambda cols: reduce(lambda x, y: x + y, cols)
    return add([c * F.sin(u) * F.cosh(v) for c, u, v in terms]), add([c * F.cos(u) * F.sinh(v) for c, u, v in terms])


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


_STEPS = ("_p_lam", "_p_psi", "_p_xi", "_p_eta", "_p_north", "_p_east", "_p_chi")


def project(df: DataFrame, p: Projection, lon: str = "lon", lat: str = "lat", east: str = "east", north: str = "north") -> DataFrame:
    """Add ``east`` and ``north`` (metres) of longitude and latitude in degrees."""
    lo, la = _finite(F.col(lon).cast("double")), _finite(F.col(lat).cast("double"))
    la = F.when(F.abs(la) <= 90.0, la)
    if p.kind == "web":
        y = F.asinh(F.tan(F.radians(F.when(F.abs(la) < 90.0, la))))  # the poles lie at infinity
        return df.withColumns({east: F.radians(lo) * p.radius, north: y * p.radius})
    e, phi = p.eccentricity, F.radians(F.abs(la))  # the map is the same on both sides of the equator
    d = df.withColumns({"_p_lam": F.radians(_degrees_apart(lo, p.lon0)), "_p_psi": F.asinh(F.tan(phi)) - e * F.atanh(e * F.sin(phi))})
    d = d.withColumns({
        "_p_xi": F.atan2(F.sinh("_p_psi"), F.cos("_p_lam")),
        "_p_eta": F.atanh(F.sin("_p_lam") / F.cosh("_p_psi")),
    })
    up, right = _waves(series(TO_GRID, p.third), "_p_xi", "_p_eta")
    side = F.when(la < 0, -p.rectifying).otherwise(p.rectifying)
    inside = F.abs("_p_eta") <= DOMAIN
    return d.withColumns({
        east: F.when(inside, _lit(p.false_east) + p.rectifying * (F.col("_p_eta") + right)),
        north: F.when(inside, _lit(p.false_north) + side * (F.col("_p_xi") + up)),
    }).drop(*_STEPS)


def unproject(df: DataFrame, p: Projection, east: str = "east", north: str = "north", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``lon`` and ``lat`` (degrees) of grid coordinates."""
    x, y = _finite(F.col(east).cast("double")), _finite(F.col(north).cast("double"))
    if p.kind == "web":
        return df.withColumns({lon: F.degrees(x / p.radius), lat: F.degrees(F.atan(F.sinh(y / p.radius)))})
    d = df.withColumns({"_p_north": (y - _lit(p.false_north)) / p.rectifying, "_p_east": (x - _lit(p.false_east)) / p.rectifying})
    up, right = _waves(series(FROM_GRID, p.third), "_p_north", "_p_east")
    d = d.withColumns({"_p_xi": F.col("_p_north") - up, "_p_eta": F.col("_p_east") - right})
    d = d.withColumn("_p_chi", F.asin(F.sin("_p_xi") / F.cosh("_p_eta")))
    geodetic = reduce(lambda a, jc: a + jc[1] * F.sin(2.0 * jc[0] * F.col("_p_chi")), enumerate(series(TO_GEODETIC, p.third), 1), F.col("_p_chi"))
    turned = F.degrees(F.atan2(F.sinh("_p_eta"), F.cos("_p_xi"))) + _lit(p.lon0)
    inside = F.abs("_p_east") <= DOMAIN
    return d.withColumns({
        lon: F.when(inside, F.pmod(turned + 180.0, F.lit(360.0)) - 180.0),
        lat: F.when(inside, F.degrees(geodetic)),
    }).drop(*_STEPS)

"""Geometry as column expressions: distances, bearings, transverse Mercator, points and rings."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Units and radii, each with the formula that uses it.
KNOTS_PER_MS = 1.94384449
ARC_RADIUS_KM = 6367.0
ARC_KM_PER_NMI = 1.8512
MEAN_RADIUS_M = 6371010.0
RATIO_RADIUS_KM = 6371.0

# The WGS84 ellipsoid and the grid that UTM lays over it.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EASTING = 0.9996, 500000.0


def _angle(lon: float | None, lat: float | None, lon1: float | None, lat1: float | None) -> float | None:
    if lon is None or lat is None or lon1 is None or lat1 is None:
        return None
    a, b = math.radians(lat), math.radians(lat1)
    try:
        cosine = math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(math.radians(lon) - math.radians(lon1))
    except ValueError:  # an infinite coordinate
        cosine = math.nan
    return math.acos(max(-1.0, min(1.0, cosine)))  # NaN counts as 1, as in SQL, where it is the greatest


@F.arrow_udf(returnType=T.DoubleType())
def _angles(lon: pa.Array, lat: pa.Array, lon1: pa.Array, lat1: pa.Array) -> pa.Array:
    return pa.array(map(_angle, lon.to_pylist(), lat.to_pylist(), lon1.to_pylist(), lat1.to_pylist()), pa.float64())


def arcdist(lon: Column, lat: Column, lon1: Column, lat1: Column, scale: str = "nmi") -> Column:
    """Spherical law of cosines; nautical miles or km.

    Over short ways the law makes the last bit of a cosine large, and the JVM's sines and cosines differ in it now
    and then from the C library's, by which databases compute. So angles are computed by the C library.
    """
    km = ARC_RADIUS_KM * _angles(*[F.lit(c).cast("double") for c in (lon, lat, lon1, lat1)])
    return km / ARC_KM_PER_NMI if scale == "nmi" else km


def ms2kn(v: Column) -> Column:
    return v * KNOTS_PER_MS


def kn2ms(v: Column) -> Column:
    return v / KNOTS_PER_MS


def haversine_m(lon: Column, lat: Column, lon1: Column, lat1: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(a) - F.radians(b)) / 2), F.lit(2.0))
    h = half(lat1, lat) + F.cos(F.radians(lat)) * F.cos(F.radians(lat1)) * half(lon1, lon)
    return F.when(h.isNotNull(), 2 * MEAN_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def bearing(lon: Column, lat: Column, lon1: Column, lat1: Column) -> Column:
    """Forward azimuth in degrees, 0 to 360."""
    a, b, d = F.radians(lat), F.radians(lat1), F.radians(lon1) - F.radians(lon)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(deg, F.lit(360.0))


def lon_lat_ratio(lat: Column) -> Column:
    """Length of 0.1 degree of longitude over 11.12 km."""
    step = F.radians(F.lit(0.1))
    a = F.pow(F.cos(F.radians(lat)), F.lit(2.0)) * F.pow(F.sin(step / 2), F.lit(2.0))
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * RATIO_RADIUS_KM / 11.12


def _series():
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # Krueger's series to the third order.
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return radius, 2 * n**0.5 / (1 + n), alpha, beta, delta


def transverse_mercator(lon: Column, lat: Column, lon0: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """Metres east of ``lon0`` and north of the equator."""
    radius, e, alpha, _, _ = _series()
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return scale * radius * x, scale * radius * y


def _meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Northern-hemisphere x, y of a UTM zone."""
    x, y = transverse_mercator(lon, lat, F.lit(_meridian(zone)), UTM_SCALE)
    return x + UTM_EASTING, y


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    radius, _, _, beta, delta = _series()
    xi, eta = y / (UTM_SCALE * radius), (x - UTM_EASTING) / (UTM_SCALE * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.lit(_meridian(zone)) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def zero_pad(n: Column, width: int) -> Column:
    """The zeros that bring a number to a constant width."""
    return F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(n.cast("string"))))


def trip_key(vessel: Column, n: Column) -> Column:
    return F.concat_ws("_", vessel, n.cast("string"))


def edges(ring: Column) -> Column:
    """``a, b`` point structs of a closed ring's sides."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


#: Where in a grid cell its middle is taken: off what round coordinates hit.
MIDDLE = 0.5 + 1e-4 * math.pi


def in_cell_ring(x: Column, y: Column, cx: Column, cy: Column, size: float, ring: Column) -> Column:
    """Inside a ring, or on a side, by the ring's ``sides`` in the point's grid cell and whether the cell's middle is ``inside``.

    On the way from the point up or down to the middle's height, then across to the middle, every side
    that is crossed changes from inside to outside or back. The way starts just right of the point: a side's end
    at its ``x`` counts as left of it on both legs, also where a point in line with an upright side is off its end.
    """
    mx, my = (cx + MIDDLE) * size, (cy + MIDDLE) * size

    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
        up = y1 + (y2 - y1) * (x - x1) / F.nullif(x2 - x1, F.lit(0.0))
        across = x1 + (x2 - x1) * (my - y1) / F.nullif(y2 - y1, F.lit(0.0))
        first = ((x1 > x) != (x2 > x)) & ((up < y) != (up < my))
        then = ((y1 > my) != (y2 > my)) & ((across <= x) != (across <= mx))
        return F.coalesce(first, F.lit(False)) != F.coalesce(then, F.lit(False))

    def touches(e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
        return ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))

    return F.exists(ring["sides"], touches) | (ring["inside"] != (F.size(F.filter(ring["sides"], crosses)) % 2 == 1))


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    """Planar distance from a point to a side ``x1, y1, x2, y2``."""
    x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(x - x1 - t * dx, F.lit(2.0)) + F.pow(y - y1 - t * dy, F.lit(2.0)))

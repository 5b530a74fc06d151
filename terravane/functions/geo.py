"""Geometry and projections as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, INV_F = 6378137.0, 298.257223563  # WGS84
E2 = (2 - 1 / INV_F) / INV_F
#: Metres for each degree of latitude.
DEGREE_M = 111_320.0


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def block_id(lat: Column, lon: Column, degrees: float = 0.25) -> Column:
    """'i_j' of the block that holds a location."""
    return F.concat_ws("_", cell(lat, degrees).cast("string"), cell(lon, degrees).cast("string"))


def on_edge(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on a closed ring."""

    def edge(i: Column) -> Column:
        p, q = ring[i], ring[i + 1]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (F.abs(cross) <= 1e-12) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.exists(F.sequence(F.lit(0), F.size(ring) - 2), edge)


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """Edges of a closed ring that a ray from the point to larger x crosses."""

    def crossed(i: Column) -> Column:
        p, q = ring[i], ring[i + 1]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 2), crossed))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Strict containment in a polygon or multipolygon: odd crossings over all rings, and on none of them."""
    odd = F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r, x, y)) % 2 == 1
    return odd & ~F.exists(rings, lambda r: on_edge(r, x, y))


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, the shorter way round; the same either way, and differences up to 180 degrees are not rounded."""
    apart = lon2 - lon1
    dx = F.when(F.abs(apart) <= 180, apart).otherwise(F.pmod(apart + 540, F.lit(360.0)) - 180) * F.cos(F.radians((lat1 + lat2) / 2)) * DEGREE_M
    dy = (lat2 - lat1) * DEGREE_M
    return F.sqrt(dx * dx + dy * dy)


def utm_zone(lon: Column) -> Column:
    """1 to 60; 180 degrees east wraps to 1."""
    return ((F.floor((lon + 180) / 6) % 60) + 1).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon)).cast("int")


def transverse_mercator(lat: Column, lon: Column, lon0: Column, k0: float = 0.9996, x0: float = 500_000.0) -> tuple[Column, Column]:
    """Easting and northing by the series in the third flattening, to sixth order terms (below a millimetre in a zone)."""
    n = 1 / (2 * INV_F - 1)
    a = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    c = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, w in enumerate(alpha, 1):
        east = east + w * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + w * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x0 + k0 * a * east, k0 * a * north


def inverse_transverse_mercator(x: Column, y: Column, lon0: Column, k0: float = 0.9996, x0: float = 500_000.0) -> tuple[Column, Column]:
    """Latitude and longitude of an easting and northing."""
    n = 1 / (2 * INV_F - 1)
    a = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = y / (k0 * a), (x - x0) / (k0 * a)
    xi1, eta1 = xi, eta
    for j, w in enumerate(beta, 1):
        xi1 = xi1 - w * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - w * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, w in enumerate(delta, 1):
        phi = phi + w * F.sin(2 * j * chi)
    return F.degrees(phi), lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))


def albers(lat: Column, lon: Column, lat0: float, lon0: float, lat1: float, lat2: float) -> tuple[Column, Column]:
    """Equal-area conic coordinates (a = WGS84's, false origin zero)."""
    e = math.sqrt(E2)

    def q_of(s: float) -> float:
        return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_of(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)

    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    q0, q1, q2 = (q_of(math.sin(p)) for p in (p0, p1, p2))
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q2 - q1)
    c = m_of(p1) ** 2 + n * q1
    rho0 = A * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = A * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return A * F.radians(lon), A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def disc_offsets(radius: float, least: float = 4.0, most: float = 40.0) -> Column:
    """Grid offsets within a disc, spaced radius / 12 but at least and at most so much."""
    step = min(max(radius / 12, least), most)
    n = math.ceil(radius / step)
    line = F.sequence(F.lit(-n), F.lit(n))
    pairs = F.flatten(F.transform(line, lambda i: F.transform(line, lambda j: F.struct((i * step).alias("dx"), (j * step).alias("dy")))))
    return F.filter(pairs, lambda p: p["dx"] * p["dx"] + p["dy"] * p["dy"] <= radius * radius)


def site_id(name: Column, lat: Column, lon: Column) -> Column:
    """'<name, cleaned>__<lat>_<lon>' at five decimals."""
    return F.concat(F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_"), F.format_string("__%.5f_%.5f", lat.cast("double"), lon.cast("double")))


def point_key(lat: Column, lon: Column, year: Column) -> Column:
    return F.format_string("%.6f_%.6f_%d", lat.cast("double"), lon.cast("double"), year.cast("int"))

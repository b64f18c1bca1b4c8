"""Projections and grid arithmetic as column expressions.

Albers and Mercator follow Snyder, "Map Projections: A Working Manual" (USGS PP 1395);
the transverse Mercator follows the Krueger series in Karney, "Transverse Mercator with an
accuracy of a few nanometers" (2011).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import uniform

# GRS80 ellipsoid, WGS84 flattening, web-map sphere.
SEMI_MAJOR = 6378137.0
GRS80_INV_F = 298.257222101
WGS84_INV_F = 298.257223563
# EPSG:5070 standard parallels, origin latitude and central meridian (degrees).
ALBERS_LAT_1, ALBERS_LAT_2, ALBERS_LAT_0, ALBERS_LON_0 = 29.5, 45.5, 23.0, -96.0
# UTM scale on the central meridian and false easting.
UTM_K0, UTM_FALSE_EASTING, UTM_SOUTH_NORTHING = 0.9996, 500000.0, 10000000.0


def _authalic_q(e: float, s: float) -> float:
    return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def albers_constants() -> dict[str, float]:
    """n, C, rho0, q at the pole and eccentricity of EPSG:5070."""
    f = 1 / GRS80_INV_F
    e = math.sqrt(f * (2 - f))
    sin1, sin2, sin0 = (math.sin(math.radians(v)) for v in (ALBERS_LAT_1, ALBERS_LAT_2, ALBERS_LAT_0))
    m1, m2 = (math.cos(math.radians(v)) / math.sqrt(1 - (e * s) ** 2) for v, s in ((ALBERS_LAT_1, sin1), (ALBERS_LAT_2, sin2)))
    q1, q2, q0 = (_authalic_q(e, s) for s in (sin1, sin2, sin0))
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    return {"e": e, "n": n, "c": c, "rho0": SEMI_MAJOR * math.sqrt(c - n * q0) / n, "qp": _authalic_q(e, 1.0)}


_ALB = albers_constants()


def _q_of(sin_phi: Column) -> Column:
    e = _ALB["e"]
    es = sin_phi * e
    return (sin_phi / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * e)) * (1 - e * e)


def albers_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:5070 metres."""
    rho = F.sqrt(F.lit(_ALB["c"]) - _q_of(F.sin(F.radians(lat))) * _ALB["n"]) * (SEMI_MAJOR / _ALB["n"])
    theta = F.radians(lon - ALBERS_LON_0) * _ALB["n"]
    return rho * F.sin(theta), F.lit(_ALB["rho0"]) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:5070 metres to (lat, lon) degrees: authalic series, then one Newton step."""
    n, c, rho0, e, qp = (_ALB[k] for k in ("n", "c", "rho0", "e", "qp"))
    dy = F.lit(rho0) - y
    rho2 = x * x + dy * dy
    q = (F.lit(c) - rho2 * (n / SEMI_MAJOR) ** 2) / n
    beta = F.asin(q / qp)
    e2, e4, e6 = e**2, e**4, e**6
    phi = (
        beta
        + F.sin(beta * 2) * (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040)
        + F.sin(beta * 4) * (23 * e4 / 360 + 251 * e6 / 3780)
        + F.sin(beta * 6) * (761 * e6 / 45360)
    )
    s = F.sin(phi)
    w = F.lit(1.0) - s * s * e2
    phi = phi + (w * w) / (F.cos(phi) * 2) * (q / (1 - e2) - s / w + F.log((1 - s * e) / (1 + s * e)) / (2 * e))
    return F.degrees(phi), F.lit(ALBERS_LON_0) + F.degrees(F.atan2(x, dy)) / n


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * SEMI_MAJOR, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * SEMI_MAJOR


def krueger_constants() -> dict[str, object]:
    """Rectifying radius and the forward (alpha) and inverse (beta) series to n^4, WGS84."""
    f = 1 / WGS84_INV_F
    n = f / (2 - f)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return {"e": math.sqrt(f * (2 - f)), "radius": radius, "alpha": alpha, "beta": beta}


_TM = krueger_constants()


def utm_zone(lon: Column) -> Column:
    """UTM zone number 1..60 of a longitude."""
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def _central_meridian(zone: Column) -> Column:
    return zone.cast("double") * 6 - 183


def utm_xy(lat: Column, lon: Column, zone: Column, northern: Column | None = None) -> tuple[Column, Column]:
    """EPSG:4326 to UTM metres of `zone`; southern zones (`northern` false, by default south of the equator) have a false northing."""
    e = _TM["e"]
    s = F.sin(F.radians(lat))
    dlon = F.radians(lon - _central_meridian(zone))
    t = F.sinh(_atanh(s) - _atanh(s * e) * e)
    xi = F.atan2(t, F.cos(dlon))
    eta = _atanh(F.sin(dlon) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for j, a in enumerate(_TM["alpha"], 1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    k = UTM_K0 * _TM["radius"]
    false_n = F.when(lat < 0 if northern is None else ~northern, UTM_SOUTH_NORTHING).otherwise(0.0)
    return east * k + UTM_FALSE_EASTING, north * k + false_n


def utm_inverse(x: Column, y: Column, zone: Column, north: bool | Column = True) -> tuple[Column, Column]:
    """UTM metres of `zone` to (lat, lon) degrees; `north` may differ by row."""
    k = UTM_K0 * _TM["radius"]
    south = F.when(north, 0.0).otherwise(UTM_SOUTH_NORTHING) if isinstance(north, Column) else 0.0 if north else UTM_SOUTH_NORTHING
    xi = (y - south) / k
    eta = (x - UTM_FALSE_EASTING) / k
    xi0, eta0 = xi, eta
    for j, b in enumerate(_TM["beta"], 1):
        xi0 = xi0 - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        eta0 = eta0 - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    e = _TM["e"]
    tau_c = F.sin(xi0) / F.sqrt(F.sinh(eta0) * F.sinh(eta0) + F.cos(xi0) * F.cos(xi0))
    # Conformal to geodetic latitude: fixed-point steps on the isometric latitude.
    psi = F.asinh(tau_c)
    s = F.aggregate(F.array_repeat(psi, 4), F.tanh(psi), lambda acc, p: F.tanh(p + _atanh(acc * e) * e))
    lat = F.degrees(F.asin(s))
    lon = _central_meridian(zone) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))
    return lat, lon


def _atanh(v: Column) -> Column:
    return F.log((v + 1) / (F.lit(1.0) - v)) * 0.5


def cell_row_col(lat: Column, lon: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Raster row and column of a point (floor, origin at the upper left corner)."""
    return F.floor((F.lit(y0) - lat) / dy).cast("long"), F.floor((lon - x0) / dx).cast("long")


def cell_label(row: Column, col: Column) -> Column:
    """Text form of a cell, used only when a table leaves the system."""
    return F.concat_ws("_", row.cast("string"), col.cast("string"))


def pixel_to_map(row: Column, col: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Map coordinates of a (possibly fractional) pixel position."""
    return x0 + col * dx, y0 - row * dy


def annulus_offset(key: Column, inner: float, outer: float, first_draw: int = 1) -> tuple[Column, Column]:
    """Area-uniform offset within [inner, outer] metres of the origin."""
    angle = uniform_angle(key, first_draw)
    dist = F.sqrt(uniform(key, first_draw + 1) * (outer**2 - inner**2) + inner**2)
    return dist * F.cos(angle), dist * F.sin(angle)


def uniform_angle(key: Column, draw: int) -> Column:
    """Uniform angle in [0, 2 pi)."""
    return uniform(key, draw) * (2 * math.pi)


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance in projected metres."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Crossing-number test; `ring` is array<struct<x,y>> without the repeated closing vertex."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a = F.element_at(ring, (i + 1).cast("int"))
        b = F.element_at(ring, ((i + 1) % n + 1).cast("int"))
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"])
        return F.when(spans, F.when(x < at, 1).otherwise(0)).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return hits % 2 == 1


def point_in_edges(x: Column, y: Column, edges: Column) -> Column:
    """Crossing-number test against all `edges` (array<struct<ax,ay,bx,by>>) of a shape, those of its holes and parts included."""

    def crosses(e: Column) -> Column:
        at = e["ax"] + (y - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])
        return F.when((e["ay"] > y) != (e["by"] > y), x < at).otherwise(F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def edge_meets_box(e: Column, x0: Column, y0: Column, side: Column) -> Column:
    """Whether an edge touches the square from (`x0`, `y0`): their boxes overlap and not all corners lie on one side of its line."""
    x1, y1 = x0 + side, y0 + side
    boxes = (F.least(e["ax"], e["bx"]) <= x1) & (F.greatest(e["ax"], e["bx"]) >= x0) & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ay"], e["by"]) >= y0)
    turn = [(e["bx"] - e["ax"]) * (cy - e["ay"]) - (e["by"] - e["ay"]) * (cx - e["ax"]) for cx in (x0, x1) for cy in (y0, y1)]
    return boxes & (F.least(*turn) <= 0) & (F.greatest(*turn) >= 0)


def padded_extent_aggs(x: Column, y: Column, share: float = 0.05, floor_m: float = 1000.0) -> list[Column]:
    """Aggregates for the padded bounding box of a point set."""
    x1, x2, y1, y2 = F.min(x), F.max(x), F.min(y), F.max(y)
    pad = F.greatest(x2 - x1, y2 - y1, F.lit(floor_m)) * share
    return [
        (x1 - pad).alias("xmin"),
        (x2 + pad).alias("xmax"),
        (y1 - pad).alias("ymin"),
        (y2 + pad).alias("ymax"),
    ]

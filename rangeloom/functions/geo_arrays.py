"""The projections of `geo` on numpy arrays, for code that holds many points at a time; same definitions and units."""

from __future__ import annotations

import numpy as np

from .geo import _ALB, _TM, ALBERS_LON_0, SEMI_MAJOR, UTM_FALSE_EASTING, UTM_K0, UTM_SOUTH_NORTHING

Pair = tuple[np.ndarray, np.ndarray]


def albers_xy(lat: np.ndarray, lon: np.ndarray) -> Pair:
    """EPSG:4326 degrees to EPSG:5070 metres."""
    n, c, rho0, e = (_ALB[k] for k in ("n", "c", "rho0", "e"))
    es = np.sin(np.radians(lat)) * e
    q = (es / e / (1 - es * es) - np.log((1 - es) / (1 + es)) / (2 * e)) * (1 - e * e)
    rho = np.sqrt(c - q * n) * (SEMI_MAJOR / n)
    theta = np.radians(lon - ALBERS_LON_0) * n
    return rho * np.sin(theta), rho0 - rho * np.cos(theta)


def albers_inverse(x: np.ndarray, y: np.ndarray) -> Pair:
    """EPSG:5070 metres to (lat, lon) degrees: authalic series, then one Newton step."""
    n, c, rho0, e, qp = (_ALB[k] for k in ("n", "c", "rho0", "e", "qp"))
    dy = rho0 - y
    q = (c - (x * x + dy * dy) * (n / SEMI_MAJOR) ** 2) / n
    beta = np.arcsin(q / qp)
    e2, e4, e6 = e**2, e**4, e**6
    s2, c2 = np.sin(beta * 2), np.cos(beta * 2)
    # Sines of four and six times beta from those of twice.
    phi = beta + s2 * ((e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) + 2 * c2 * (23 * e4 / 360 + 251 * e6 / 3780) + (3 - 4 * s2 * s2) * (761 * e6 / 45360))
    s = np.sin(phi)
    w = 1.0 - s * s * e2
    phi = phi + (w * w) / (np.cos(phi) * 2) * (q / (1 - e2) - s / w + np.log((1 - s * e) / (1 + s * e)) / (2 * e))
    return np.degrees(phi), ALBERS_LON_0 + np.degrees(np.arctan2(x, dy)) / n


def _series(terms: list[float], xi: np.ndarray, eta: np.ndarray) -> Pair:
    """Sums over j of a_j sin(2j xi) cosh(2j eta) and of a_j cos(2j xi) sinh(2j eta): the parts of a sine series, by Clenshaw's steps."""
    sin, cos, sinh, cosh = np.sin(xi * 2), np.cos(xi * 2), np.sinh(eta * 2), np.cosh(eta * 2)
    first = sin * cosh + 1j * (cos * sinh)
    twice = 2 * (cos * cosh - 1j * (sin * sinh))
    a = b = 0.0
    for t in reversed(terms):
        a, b = t + twice * a - b, a
    out = a * first
    return out.real, out.imag


def _atanh(v: np.ndarray) -> np.ndarray:
    return np.log((v + 1) / (1.0 - v)) * 0.5


def _central_meridian(zone: np.ndarray) -> np.ndarray:
    return zone * 6.0 - 183


def utm_xy(lat: np.ndarray, lon: np.ndarray, zone: np.ndarray, north: np.ndarray) -> Pair:
    """EPSG:4326 to UTM metres of `zone`; southern zones (`north` false) have a false northing."""
    e = _TM["e"]
    s = np.sin(np.radians(lat))
    dlon = np.radians(lon - _central_meridian(zone))
    t = np.sinh(_atanh(s) - _atanh(s * e) * e)
    xi = np.arctan2(t, np.cos(dlon))
    eta = _atanh(np.sin(dlon) / np.sqrt(t * t + 1))
    up, right = _series(_TM["alpha"], xi, eta)
    k = UTM_K0 * _TM["radius"]
    return (eta + right) * k + UTM_FALSE_EASTING, (xi + up) * k + np.where(north, 0.0, UTM_SOUTH_NORTHING)


def utm_inverse(x: np.ndarray, y: np.ndarray, zone: np.ndarray, north: np.ndarray) -> Pair:
    """UTM metres of `zone` to (lat, lon) degrees."""
    k, e = UTM_K0 * _TM["radius"], _TM["e"]
    xi, eta = (y - np.where(north, 0.0, UTM_SOUTH_NORTHING)) / k, (x - UTM_FALSE_EASTING) / k
    up, right = _series(_TM["beta"], xi, eta)
    xi, eta = xi - up, eta - right
    # Conformal to geodetic latitude: fixed-point steps on the isometric latitude.
    psi = np.arcsinh(np.sin(xi) / np.sqrt(np.sinh(eta) * np.sinh(eta) + np.cos(xi) * np.cos(xi)))
    s = np.tanh(psi)
    for _ in range(4):
        s = np.tanh(psi + _atanh(s * e) * e)
    return np.degrees(np.arcsin(s)), _central_meridian(zone) + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi)))

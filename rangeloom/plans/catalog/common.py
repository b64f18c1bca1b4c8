"""Pieces the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raster grid of the queries: origin 180 W, 90 N, 1/128 degree cells (exact in binary).
GRID = (-180.0, 90.0, 1 / 128, 1 / 128)
CELL_SQL = "CAST(floor((90 - {a}lat) / 0.0078125) AS BIGINT) AS cell_row, CAST(floor(({a}lon + 180) / 0.0078125) AS BIGINT) AS cell_col"
SEED = 42


def rnd(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double for comparison."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, digits)
    return out.alias(name or (c if isinstance(c, str) else None))


# Albers metres of lat, lon in SQL (Snyder), constants as in the projection's definition.
_A, _E = 6378137.0, 0.08181919104281579
_N, _C, _RHO0 = 0.60290276906576, 1.3491820315609702, 9928937.004248783


def albers_sql(lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y") -> str:
    """Two SQL select items with the projected metres."""
    s = f"sin(radians({lat}))"
    q = f"((1 - {_E}*{_E}) * ({s} / (1 - ({_E}*{s})*({_E}*{s})) - ln((1 - {_E}*{s}) / (1 + {_E}*{s})) / (2*{_E})))"
    rho = f"({_A} / {_N} * sqrt({_C} - {_N} * {q}))"
    th = f"({_N} * radians({lon} + 96))"
    return f"{rho} * sin({th}) AS {x}, {_RHO0} - {rho} * cos({th}) AS {y}"


def albers_inverse_sql(x: str, y: str) -> str:
    """Two SQL select items `lat`, `lon` of projected metres."""
    e2, e4, e6 = _E**2, _E**4, _E**6
    qp = 1.9955310874809387
    q = f"(({_C} - ({x}*{x} + ({_RHO0} - {y})*({_RHO0} - {y})) * {(_N / _A) ** 2!r}) / {_N})"
    b = f"asin({q} / {qp})"
    phi = (
        f"({b} + {e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040!r} * sin(2*{b}) + {23 * e4 / 360 + 251 * e6 / 3780!r} * sin(4*{b})"
        f" + {761 * e6 / 45360!r} * sin(6*{b}))"
    )
    s = f"sin({phi})"
    w = f"(1 - {e2!r} * {s} * {s})"
    step = f"({w}*{w} / (2*cos({phi})) * ({q} / {1 - e2!r} - {s} / {w} + ln((1 - {_E}*{s}) / (1 + {_E}*{s})) / (2*{_E})))"
    return f"degrees({phi} + {step}) AS lat, -96 + degrees(atan2({x}, {_RHO0} - {y})) / {_N} AS lon"


def uniform_sql(key: str, draw: int) -> str:
    """Uniform draw in SQL."""
    return f"(CAST(CAST(concat('0x', substr(md5(concat({key}, ':{draw}')), 1, 13)) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"

"""Grid affine and UTM zone 51N <-> WGS84 as column expressions (third-order Krueger series)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS84 ellipsoid and UTM zone 51 north
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, CENTRAL_MERIDIAN = 0.9996, 500000.0, 123.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
ECC = 2 * math.sqrt(N) / (1 + N)


def pixel_center(row: Column, col: Column, origin_x: float, origin_y: float, size: float) -> tuple[Column, Column]:
    """Map coordinates of a pixel centre on a north-up grid."""
    return F.lit(origin_x) + (col + 0.5) * size, F.lit(origin_y) - (row + 0.5) * size


def pixel_of(x: Column, y: Column, origin_x: float, origin_y: float, size_x: float, size_y: float) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a coordinate."""
    return F.floor((F.lit(origin_y) - y) / size_y), F.floor((x - F.lit(origin_x)) / size_x)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - CENTRAL_MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan(t / F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * RADIUS * e, SCALE * RADIUS * n


def to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    xi, eta = y / (SCALE * RADIUS), (x - FALSE_EASTING) / (SCALE * RADIUS)
    xi_p, eta_p = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi_p = xi_p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_p = eta_p - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.lit(CENTRAL_MERIDIAN) + F.degrees(F.atan(F.sinh(eta_p) / F.cos(xi_p))), F.degrees(phi)

"""Directions, distances and source shapes as column expressions.

Scene convention: azimuth grows to the left, 0 is front, degrees; x is right,
y front, z up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_azimuth(az: Column) -> Column:
    """Into (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - az, F.lit(360.0))


def to_polar(x: Column, y: Column, z: Column) -> Column:
    """``azimuth, elevation, distance`` of a Cartesian position."""
    flat = F.sqrt(x * x + y * y)
    return F.struct(
        F.degrees(F.atan2(-x, y)).alias("azimuth"),
        F.degrees(F.atan2(z, flat)).alias("elevation"),
        F.sqrt(x * x + y * y + z * z).alias("distance"),
    )


def unit_vector(az: Column, el: Column) -> Column:
    """``x, y, z`` of a direction."""
    a, e = F.radians(az), F.radians(el)
    return F.struct((-F.sin(a) * F.cos(e)).alias("x"), (F.cos(a) * F.cos(e)).alias("y"), F.sin(e).alias("z"))


def chord(p: Column, q: Column) -> Column:
    """Straight distance of two positions with ``x, y, z``."""
    return F.sqrt(sum((p[c] - q[c]) * (p[c] - q[c]) for c in ("x", "y", "z")))


def planar_gap(az1: Column, el1: Column, az2: Column, el2: Column) -> Column:
    """Squared distance in the azimuth-elevation plane; azimuth is circular."""
    d = wrap_azimuth(az1 - az2)
    return d * d + (el1 - el2) * (el1 - el2)


def offset_polar(az, el, dist, d_az, d_el, d_dist) -> Column:
    """A polar position moved by an offset; elevation and distance stay in range."""
    return F.struct(
        wrap_azimuth(az + d_az).alias("azimuth"),
        F.least(F.greatest(el + d_el, F.lit(-90.0)), F.lit(90.0)).alias("elevation"),
        F.greatest(dist + d_dist, F.lit(0.0)).alias("distance"),
    )


def diverged(divergence: Column, angle: Column) -> Column:
    """One source, or three: ``turn`` (degrees) and ``weight`` of each."""
    d = F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0))
    a = F.least(F.greatest(angle, F.lit(0.0)), F.lit(120.0))
    source = lambda turn, w: F.struct(turn.alias("turn"), w.alias("weight"))
    side = d / (d + 1)
    three = F.array(source(-a, side), source(F.lit(0.0), (1 - d) / (d + 1)), source(a, side))
    return F.when(d > 1e-4, three).otherwise(F.array(source(F.lit(0.0), F.lit(1.0))))


def nearness(distance: Column) -> Column:
    """How much wider a source looks when it is near."""
    return F.least(F.greatest(1 / F.greatest(distance, F.lit(0.4)), F.lit(0.5)), F.lit(2.5))


def _sizes(width: Column, height: Column, depth: Column) -> tuple[Column, Column, Column]:
    return tuple(F.greatest(v, F.lit(0.0)) * k for v, k in ((width, 60), (height, 45), (depth, 20)))


def extent_radii(width: Column, height: Column, depth: Column, distance: Column) -> Column:
    """Half-angles (degrees) of an extended source; depth widens both."""
    w, h, d = _sizes(width, height, depth)
    near = nearness(distance)
    return F.struct((w * near + d * near).alias("width"), (h * near + d * near).alias("height"))


def ring(n: int, radius: float, weight: float) -> list[tuple[float, float, float]]:
    """``n`` places on a circle, each with a share of ``weight``."""
    step = 2 * math.pi / n
    return [(radius * math.cos(k * step), radius * math.sin(k * step), weight / n) for k in range(n)]


def extent_disk() -> list[tuple[float, float, float]]:
    """``x, y, weight`` over a disk: two thirds on the rim, a third half way in."""
    return ring(8, 1.0, 2 / 3) + ring(8, 0.5, 1 / 3)


def extent_places(radii: Column) -> Column:
    """``k, x, y, weight`` of the places that stand for a source: those of the
    disk, or its centre alone if it has no extent to speak of."""
    place = lambda k, x, y, w: F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"))
    disk = F.array(*(place(k, x, y, w) for k, (x, y, w) in enumerate(extent_disk())))
    point = (radii["width"] <= 1e-4) & (radii["height"] <= 1e-4)
    return F.when(point, F.array(place(0, 0.0, 0.0, 1.0))).otherwise(disk)


def extent_direction(az: Column, el: Column, radii: Column, x: Column, y: Column) -> Column:
    """Direction of a place of the disk around a source: ``azimuth, elevation``."""
    c = unit_vector(az, el)
    flat = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])
    level = flat >= 1e-4  # else straight up or down: to the right is x
    hx, hy = F.when(level, -c["y"] / flat).otherwise(1.0), F.when(level, c["x"] / flat).otherwise(0.0)
    vx, vy, vz = -c["z"] * hy, c["z"] * hx, c["x"] * hy - c["y"] * hx
    h, v = F.tan(F.radians(x * radii["width"])), F.tan(F.radians(y * radii["height"]))
    polar = to_polar(c["x"] + hx * h + vx * v, c["y"] + hy * h + vy * v, c["z"] + vz * v)
    return F.struct(polar["azimuth"].alias("azimuth"), polar["elevation"].alias("elevation"))


def spread_angle(width: Column, height: Column, depth: Column, distance: Column, divergence: Column, range_: Column) -> Column:
    """Amplitude-panning spread; divergence may widen it."""
    near = nearness(distance)
    w, h, d = (v * near for v in _sizes(width, height, depth))
    w = F.when(divergence > 1e-4, F.greatest(w, F.greatest(range_, F.lit(0.0)) * 0.5)).otherwise(w)
    return F.least(F.lit(180.0), F.sqrt(w * w + h * h + d * d))


def cone_angle(width: Column, height: Column, depth: Column) -> Column:
    """Binaural cone; does not depend on distance."""
    w, h, d = _sizes(width, height, depth)
    return F.greatest(w + d, h + d) * 2


def head_rotation(yaw: float, pitch: float, roll: float) -> list[list[float]]:
    """Inverse of the rotation yaw, then pitch, then roll (degrees): a 3x3 matrix for
    positions in the listener's axes."""
    y, p, r = (math.radians(v) for v in (yaw, pitch, roll))
    cy, sy, cp, sp, cr, sr = math.cos(y), math.sin(y), math.cos(p), math.sin(p), math.cos(r), math.sin(r)
    rz = [[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]]
    rx = [[1, 0, 0], [0, cp, -sp], [0, sp, cp]]
    ry = [[cr, 0, sr], [0, 1, 0], [-sr, 0, cr]]
    mul = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    m = mul(mul(rz, rx), ry)
    return [[m[j][i] for j in range(3)] for i in range(3)]


def rotated(p: Column, m: list[list[float]]) -> Column:
    return F.struct(*(sum(p[c] * m[i][k] for k, c in enumerate("xyz")).alias(n) for i, n in enumerate("xyz")))


def grid_cell(az: Column, el: Column) -> Column:
    """Cell of a 1-degree grid, 361 columns from -180 by 181 rows from -90."""
    half_away = lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5)
    col = half_away(wrap_azimuth(az)) + 180
    row = half_away(F.least(F.greatest(el, F.lit(-90.0)), F.lit(90.0))) + 90
    return (row * 361 + col).cast("int")

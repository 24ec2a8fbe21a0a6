"""Real spherical harmonics to third order, ACN order, SN3D scale.

Ambisonic axes: x front, y left, z up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def axes(az: Column, el: Column) -> tuple[Column, Column, Column]:
    a, e = F.radians(az), F.radians(el)
    return F.cos(a) * F.cos(e), F.sin(a) * F.cos(e), F.sin(e)


def harmonics(az: Column, el: Column, order: int = 3) -> Column:
    """``(order + 1) ** 2`` gains of a plane wave from a direction."""
    x, y, z = axes(az, el)
    s = math.sqrt
    terms = [
        F.lit(1.0), y, z, x,
        s(3) * x * y, s(3) * y * z, (3 * z * z - 1) / 2, s(3) * x * z, s(3) / 2 * (x * x - y * y),
        s(5 / 8) * y * (3 * x * x - y * y), s(15) * x * y * z, s(3 / 8) * y * (5 * z * z - 1), z * (5 * z * z - 3) / 2,
        s(3 / 8) * x * (5 * z * z - 1), s(15) / 2 * z * (x * x - y * y), s(5 / 8) * x * (x * x - 3 * y * y),
    ]
    return F.array(*terms[: (order + 1) ** 2])


def degree_scale(order: int = 3) -> list[float]:
    """SN3D to N3D for each channel."""
    return [math.sqrt(2 * math.isqrt(k) + 1) for k in range((order + 1) ** 2)]


def energy_split(diffuse: Column) -> Column:
    """Gains of the direct and the diffuse part."""
    return F.struct(F.sqrt(1 - diffuse).alias("direct"), F.sqrt(diffuse).alias("diffuse"))


def full_normalised(acn: Column, value: Column) -> Column:
    """From the semi-normalised (SN3D) to the fully normalised (N3D) scale of a channel number."""
    return value * F.sqrt(2 * F.floor(F.sqrt(acn.cast("double"))) + 1)

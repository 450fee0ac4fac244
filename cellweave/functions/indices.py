"""Spectral indices as column expressions over co-registered bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), and -1 where the sum is 0."""
    return F.when(a + b == 0, F.lit(-1.0)).otherwise(F.try_divide(a - b, a + b))


def water(name: str, blue: Column, green: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    """Water indices of surface reflectance bands."""
    table = {
        "awei_noshadow": lambda: 4 * (green - swir1) - (0.25 * nir + 2.75 * swir2),
        "awei_shadow": lambda: blue + 2.5 * green - 1.5 * (nir + swir1) - 0.25 * swir2,
        "lswi": lambda: normalized(nir, swir1),
        "ndwi_mf": lambda: normalized(green, nir),
        "ndwi_x": lambda: normalized(green, swir1),
    }
    return table[name]()


def vegetation(name: str, red: Column, nir: Column, blue: Column, green: Column, *, soil: float = 0.5, slope: float = 1.0) -> Column:
    """Vegetation indices; ``soil`` is the adjustment of SAVI, ``slope`` that of the soil line. Where a divisor is 0 they are null."""
    div = F.try_divide
    gemi = lambda: div(2 * (nir * nir - red * red) + 1.5 * nir + 0.5 * red, nir + red + 0.5)
    table = {
        "sr": lambda: div(nir, red),
        "ndvi": lambda: div(nir - red, nir + red),
        "ipvi": lambda: div(nir, nir + red),
        "dvi": lambda: nir - red,
        "wdvi": lambda: nir - slope * red,
        "savi": lambda: div((1 + soil) * (nir - red), nir + red + soil),
        "msavi2": lambda: (2 * nir + 1 - F.sqrt(F.greatest(F.lit(0.0), F.pow(2 * nir + 1, F.lit(2)) - 8 * (nir - red)))) / 2,
        "gemi": lambda: gemi() * (1 - 0.25 * gemi()) - div(red - 0.125, 1 - red),
        "arvi": lambda: div(nir - (2 * red - blue), nir + (2 * red - blue)),
        "gari": lambda: div(nir - (green - (blue - red)), nir + (green - (blue - red))),
        "evi": lambda: div(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1),
        "vari": lambda: div(green - red, green + red - blue),
    }
    return table[name]()


def change_vector(dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """Angle in degrees from 0 to 360, magnitude, and quadrant from 1 to 4 of a change in two dimensions."""
    angle = F.when((dx == 0) & (dy == 0), None).otherwise(F.degrees(F.atan2(dy, dx)))
    angle = F.when(angle < 0, angle + 360).otherwise(angle)
    return angle, F.sqrt(dx * dx + dy * dy), F.when(angle <= 90, 1).when(angle <= 180, 2).when(angle <= 270, 3).when(angle <= 360, 4)


def spectral_angle(a: Column, b: Column) -> Column:
    """Angle between two band arrays in degrees, over the dot product; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

"""Weights that fall with distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_kernel(u: Column, name: str) -> Column:
    """Weight at a distance ``u`` from 0 on, 0 from 1 on."""
    inside = {
        "epanechnikov": 1 - u * u,
        "bisquare": F.pow(1 - u * u, F.lit(2)),
        "tricube": F.pow(1 - F.pow(u, F.lit(3)), F.lit(3)),
        "cosine": F.cos(F.pi() * u / 2),
    }[name]
    return F.when(u.isNull(), None).when(u >= 1, 0.0).otherwise(inside)


def distance_kernel(d2: Column, bandwidth: float, name: str) -> Column:
    """Weight at a squared distance in cells; 0 beyond the bandwidth."""
    edge = bandwidth + 1
    inside = {
        "epanechnikov": 1 - d2 / edge**2,
        "bisquare": F.pow(1 - d2 / edge**2, F.lit(2)),
        "tricube": F.pow(1 - F.pow(d2, F.lit(1.5)) / edge**3, F.lit(3)),
        "gauss": F.exp(-0.5 * d2 / bandwidth**2),
    }[name]
    return F.when(d2.isNull(), None).when(d2 > bandwidth**2, 0.0).otherwise(inside)

"""Closed formulas of cell values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponential_growth(n0: Column, rate: float, steps: int) -> Column:
    """A population after so many steps of unlimited growth."""
    return n0 * F.exp(F.lit(float(rate * steps)))


def ricker_growth(n0: Column, rate: float, capacity: float, steps: int) -> Column:
    """A population after so many steps of growth that falls with crowding."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), n0.cast("double"), lambda n, _: n * F.exp(rate * (1 - n / capacity)))


def bare_soil_loss(length_slope: Column, rain: Column, erodibility: Column) -> Column:
    """Annual soil loss of bare ground: the product of the three factors."""
    return length_slope * rain * erodibility


def disjoint_restrictions(value: Column, *restricted: Column) -> Column:
    """The value where none of the restrictions holds; 0 where one does, null where the value is missing."""
    any_ = F.lit(False)
    for r in restricted:
        any_ = any_ | F.coalesce(r, F.lit(False))
    return F.when(value.isNull(), None).when(any_, 0.0).otherwise(value)


def polynomial(v: Column, coefficients: tuple[float, ...]) -> Column:
    """A polynomial by Horner's rule, constant first."""
    out: Column = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * v + F.lit(float(c))
    return out


def net_present_value(cost: Column, revenue: Column, rate: float, years: int) -> Column:
    """What equal yearly revenues are worth today, less the cost."""
    return revenue * ((1 - (1 + rate) ** -years) / rate if rate else float(years)) - cost

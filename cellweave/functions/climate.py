"""Radiation, evaporation and humidity as column expressions. Numbers in them are the fixed coefficients of the published formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLAR_CONSTANT = 1367.0  # W/m2
STEFAN_BOLTZMANN = 5.67e-8
SECONDS_PER_DAY = 86400.0


def saturation_pressure(celsius: Column) -> Column:
    """Saturated vapour pressure in kPa."""
    return 0.61078 * F.exp(F.try_divide(17.2694 * celsius, celsius + 237.3))


def daily_solar(latitude: Column, day: Column, transmissivity: Column) -> Column:
    """Daily solar radiation on flat ground in W/m2; null where the sun doesn't set or rise."""
    season = 2 * F.pi() * day / 365
    tilt, lat = 0.4093 * F.sin(season - 1.39), F.radians(latitude)
    reach = 1 + 0.01672 * F.sin(2 * F.pi() * (day - 93.5) / 365)
    turn = -F.tan(lat) * F.tan(tilt)
    ws = F.acos(F.when(turn.between(-1, 1), turn))
    above = ws * F.sin(tilt) * F.sin(lat) + F.cos(tilt) * F.cos(lat) * F.sin(ws)
    return above * SOLAR_CONSTANT * transmissivity / (F.pi() * reach * reach)


def net_radiation(albedo: Column, solar: Column, transmissivity: Column) -> Column:
    """Daily net radiation from broadband albedo."""
    return (1 - albedo) * solar - 110 * transmissivity


def net_radiation_longwave(albedo: Column, solar: Column, air_emissivity: Column, ground_emissivity: Column, air_kelvin: Column) -> Column:
    """Daily net radiation with the longwave balance from emissivities."""
    return (1 - albedo) * solar - (air_emissivity - ground_emissivity) * STEFAN_BOLTZMANN * F.pow(air_kelvin, F.lit(4))


def potential_evaporation(net: Column, kelvin: Column, water_density: float = 1000.0) -> Column:
    """Evaporation in mm a day that the net radiation can pay for."""
    latent = (2.501 - 0.002361 * (kelvin - 273.15)) * 1e6
    return net * SECONDS_PER_DAY * 1000 / (latent * water_density)


def evaporative_fraction(kelvin: Column, hot: float, cold: float) -> Column:
    """How near a surface is to the cold, wet end of the temperatures, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hot - kelvin) / (hot - cold)))


def roughness(ndvi: Column, ndvi_max: float, crop_height: float, desert_height: float = 0.002) -> Column:
    """Momentum roughness length in m, log-linear between bare ground and full cover."""
    from math import log

    rise = (log(crop_height / 7) - log(desert_height)) / (ndvi_max - 0.02)
    return F.exp(log(desert_height) + rise * (ndvi - 0.02))


def temperature_gap(kelvin: Column) -> Column:
    """Difference of skin and air temperature from the skin's, held between 1 and 13."""
    return F.greatest(F.lit(1.0), F.least(F.lit(13.0), -321.147 + 1.095 * kelvin))


def open_water(albedo: Column, ndvi: Column) -> Column:
    """1 where both are low, else 0; null where one is missing."""
    return F.when(albedo.isNull() | ndvi.isNull(), None).when((albedo < 0.1) & (ndvi < 0.1), 1).otherwise(0)


def quality_bits(code: Column, start: int, length: int, accepted: list[int]) -> Column:
    """Whether a field of bits of a quality code holds an accepted number."""
    return F.shiftright(code, start).bitwiseAND((1 << length) - 1).isin(accepted)

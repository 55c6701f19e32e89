"""Weather physics and quality rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnus and Tetens coefficients, and the limits of the hourly quality rules.
MAGNUS_A, MAGNUS_B = 17.625, 243.04
TETENS_E0, TETENS_A, TETENS_B = 6.112, 17.67, 243.5
LIMITS = {"temperature": (-35.0, 55.0), "dewpoint": (-45.0, 35.0), "humidity": (0.0, 100.0), "pressure": (850.0, 1090.0), "wind_speed": (0.0, 75.0), "wind_direction": (0.0, 360.0), "precipitation": (0.0, 350.0), "solar": (0.0, 1450.0)}
EARTH_KM = 6371.0
GROSS = {"temperature": (-90.0, 60.0), "pressure": (400.0, 1100.0), "humidity": (0.0, 100.0)}
STEPS = {"temperature": 12.0, "dewpoint": 12.0, "pressure": 8.0, "wind_speed": 30.0, "humidity": 50.0}


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def dew_point(t: Column, rh: Column) -> Column:
    """Magnus dew point, humidity held to 0.001..120 and the result to -60..60."""
    g = F.ln(clip(rh, 1e-3, 120.0) / 100.0) + MAGNUS_A * t / (MAGNUS_B + t)
    return clip(MAGNUS_B * g / (MAGNUS_A - g), -60.0, 60.0)


def saturation_pressure(t: Column) -> Column:
    return TETENS_E0 * F.exp(TETENS_A * t / (t + TETENS_B))


def vapour_deficit(t: Column, rh: Column) -> Column:
    return saturation_pressure(t) * (1.0 - clip(rh, 0.0, 100.0) / 100.0)


def humidity_from_dew_point(t: Column, td: Column, clipped: bool = True) -> Column:
    rh = 100.0 * F.exp(MAGNUS_A * td / (MAGNUS_B + td) - MAGNUS_A * t / (MAGNUS_B + t))
    return clip(rh, 0.0, 100.0) if clipped else F.when(F.isnan(rh), None).otherwise(rh)


def wind_components(speed: Column, degrees: Column) -> tuple[Column, Column]:
    return -speed * F.sin(F.radians(degrees)), -speed * F.cos(F.radians(degrees))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def outside(x: Column, bounds: tuple[float, float]) -> Column:
    return F.coalesce((x < bounds[0]) | (x > bounds[1]), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))

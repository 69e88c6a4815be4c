"""Humidity, solar angle, units, distances and map projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Magnus coefficients, ratio of gas constants, Earth radius (m), zero Celsius (K).
MAGNUS_A, MAGNUS_B, MAGNUS_E0 = 17.67, 243.5, 6.112
EPSILON, ONE_LESS_EPSILON = 0.622, 0.378
EARTH_RADIUS = 6371000.0
ZERO_CELSIUS = 273.15

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vapour_pressure(t: C) -> Column:
    """Saturation vapour pressure (hPa) at a temperature in degrees Celsius."""
    return MAGNUS_E0 * F.exp(MAGNUS_A * _c(t) / (_c(t) + MAGNUS_B))


def relative_humidity(t: C, td: C) -> Column:
    return 100.0 * vapour_pressure(td) / vapour_pressure(t)


def relative_humidity_rule(t: C, td: C) -> Column:
    return 100.0 - 5.0 * (_c(t) - _c(td))


def specific_humidity(p: C, td: C) -> Column:
    e = vapour_pressure(td)
    return EPSILON * e / (_c(p) - ONE_LESS_EPSILON * e)


def specific_humidity_mixed(p: C, td: C) -> Column:
    """The second variant: the mixing ratio, in grams, enters as a percentage."""
    share = vapour_pressure(td) / (_c(p) - vapour_pressure(td))
    return EPSILON * share * (1000.0 * EPSILON * share / 100.0)


def kelvin_to_celsius(t: C) -> Column:
    return _c(t) - ZERO_CELSIUS


def solar_zenith(lat: C, date: C, hour: C) -> Column:
    """Degrees from the zenith, by declination and hour angle."""
    tilt = F.radians(-23.45 * F.cos(2 * math.pi / 365 * (F.dayofyear(_c(date)) + 10)))
    turn = F.radians(15.0 * (_c(hour) - 12))
    here = F.radians(_c(lat))
    high = F.sin(here) * F.sin(tilt) + F.cos(here) * F.cos(tilt) * F.cos(turn)
    return F.degrees(F.acos(F.least(F.greatest(high, F.lit(-1.0)), F.lit(1.0))))


def reanalysis_derived(df: DataFrame) -> DataFrame:
    """Adds rh and difr, drops the variables that were only needed for them."""
    out = df.withColumn("rh", relative_humidity(kelvin_to_celsius("t2m"), kelvin_to_celsius("d2m")))
    out = out.withColumn("difr", F.col("ssrd") - F.col("fdir"))
    return out.drop("d2m", "ssrd", "fdir", "avg_sdlwrf", "avg_snlwrf", "tcc", "sp")


def haversine(lon1: C, lat1: C, lon2: C, lat2: C, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle distance in the unit of the radius."""
    half = lambda a, b: F.sin((F.radians(_c(b)) - F.radians(_c(a))) / 2)
    a = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(_c(lat1))) * F.cos(F.radians(_c(lat2))) * F.pow(half(lon1, lon2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def equirectangular(lon1: C, lat1: C, lon2: C, lat2: C, radius: float = EARTH_RADIUS) -> Column:
    dx = (F.radians(_c(lon2)) - F.radians(_c(lon1))) * F.cos((F.radians(_c(lat1)) + F.radians(_c(lat2))) / 2)
    return radius * F.hypot(dx, F.radians(_c(lat2)) - F.radians(_c(lat1)))


def planar(x1: C, y1: C, x2: C, y2: C) -> Column:
    return F.hypot(_c(x2) - _c(x1), _c(y2) - _c(y1))


def grid_spacing(df: DataFrame) -> DataFrame:
    """Mean steps of the axes as metres at every cell: dx shrinks with latitude."""
    axes = df.agg(
        ((F.max("lon") - F.min("lon")) / (F.count_distinct("lon") - 1)).alias("sx"),
        ((F.max("lat") - F.min("lat")) / (F.count_distinct("lat") - 1)).alias("sy"),
    )
    cells = df.select("lat", "lon").distinct().crossJoin(F.broadcast(axes))
    return cells.select(
        "lat", "lon",
        (EARTH_RADIUS * F.cos(F.radians("lat")) * F.radians("sx")).alias("dx"),
        (EARTH_RADIUS * F.radians("sy")).alias("dy"),
    )


def tm35fin_to_lonlat(x: C, y: C) -> tuple[Column, Column]:
    """ETRS-TM35FIN metres to longitude and latitude, by the Krueger series of the third flattening."""
    # GRS80 ellipsoid, central meridian 27 E, scale 0.9996, false easting 500 km.
    f, a, k0, lon0, east = 1 / 298.257222101, 6378137.0, 0.9996, 27.0, 500000.0
    n = f / (2 - f)
    rectified = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = _c(y) / (k0 * rectified), (_c(x) - east) / (k0 * rectified)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def project_tm35fin(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    lon, lat = tm35fin_to_lonlat(x, y)
    return df.withColumns({"lon": lon, "lat": lat})

"""Calendar columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_of_year(time: Column | str, drop_feb29: bool = True) -> Column:
    """1..365, later days of leap years moved back by one, null on Feb 29; or the plain 1..366."""
    time = F.col(time) if isinstance(time, str) else time
    doy = F.dayofyear(time)
    if not drop_feb29:
        return doy
    year = F.year(time)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(leap & (doy == 60), None).otherwise(doy - (leap & (doy > 60)).cast("int"))


def calendar_columns(df: DataFrame, time_col: str = "time", hydro_start: int = 9) -> DataFrame:
    if not 1 <= hydro_start <= 12:
        raise ValueError("hydro_start must be a month number")
    t = F.col(time_col)
    return df.withColumns({
        "year": F.year(t), "month": F.month(t), "doy": F.dayofyear(t), "hour": F.hour(t), "date": F.to_date(t),
        "hydro_year": F.year(t) + (F.month(t) >= hydro_start).cast("int"),
    })


def cyclical_features(df: DataFrame, kinds: Sequence[str] = ("ann", "mon", "wee", "diu", "chn"), time_col: str = "time") -> DataFrame:
    """Sine and cosine of the place in a cycle; `chn` is the year as a trend."""
    t = F.col(time_col)
    # The length of each cycle.
    places = {
        "ann": F.dayofyear(t) / 366.0,
        "mon": F.dayofmonth(F.last_day(t)) / 31.0,
        "wee": F.weekday(t) / 7.0,
        "diu": F.hour(t) / 24.0,
    }
    new: dict[str, Column] = {}
    for k in kinds:
        if k == "chn":
            new["Cycle_years"] = F.year(t)
        else:
            new[f"Cycle_{k}_sin"], new[f"Cycle_{k}_cos"] = F.sin(2 * math.pi * places[k]), F.cos(2 * math.pi * places[k])
    return df.withColumns(new)


def hour_of_year(time: str = "time") -> Column:
    """0..8759, null on Feb 29."""
    return (day_of_year(time) - 1) * 24 + F.hour(time)

"""Terrain features on grids keyed (region, iy, ix); per region."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivalis.operators.linepass import blackman_weights, box_pass, gaussian_weights, line_pass
from nivalis.tables import settle

KEYS = ("region", "iy", "ix")
_TINY = 1e-12


def with_stats(df: DataFrame, columns: Mapping[str, Column], by: str = "region") -> DataFrame:
    """Adds each column under its name, and its mean, deviation, least and largest value per group as
    <name>_m, _s, _lo, _hi. All are taken in one partial aggregate, whose table (a row a group) is
    written: so a chain of levels computes the plan above it once a level, and no window holds a
    whole region."""
    named = df.withColumns(dict(columns))
    aggs = [f(c).alias(f"{c}{end}") for c in columns for f, end in ((F.avg, "_m"), (F.stddev_pop, "_s"), (F.min, "_lo"), (F.max, "_hi"))]
    return named.join(settle(named.groupBy(by).agg(*aggs), "stats"), by)


def _z(name: str) -> Column:
    return (F.col(name) - F.col(f"{name}_m")) / (F.col(f"{name}_s") + _TINY)


def _n(name: str) -> Column:
    return (F.col(name) - F.col(f"{name}_lo")) / (F.col(f"{name}_hi") - F.col(f"{name}_lo") + _TINY)


def _without_stats(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(f"{n}{end}" for n in names for end in ("", "_m", "_s", "_lo", "_hi")))


def zscore(df: DataFrame, value: Column | str, name: str, by: str = "region") -> DataFrame:
    out = with_stats(df, {"_v": F.col(value) if isinstance(value, str) else value}, by)
    return _without_stats(out.withColumn(name, _z("_v")), "_v")


def norm01(df: DataFrame, value: Column | str, name: str, by: str = "region") -> DataFrame:
    out = with_stats(df, {"_v": F.col(value) if isinstance(value, str) else value}, by)
    return _without_stats(out.withColumn(name, _n("_v")), "_v")


def _smoothed(df: DataFrame, values: Sequence[str], along: Callable[[DataFrame, str, str, list[str]], DataFrame]) -> DataFrame:
    """Both passes of a separable filter over numerators (0 for null) and presence; (keys, value...).
    `along` is a pass over (cells, line, position, columns)."""
    cols = {c: e for v in values for c, e in ((f"_n_{v}", F.coalesce(F.col(v), F.lit(0.0))), (f"_d_{v}", F.col(v).isNotNull().cast("double")))}
    out = df.select(*KEYS, *(e.alias(c) for c, e in cols.items()))
    out = along(along(out, "iy", "ix", list(cols)), "ix", "iy", list(cols))
    return out.select(*KEYS, *(F.try_divide(f"_n_{v}", f"_d_{v}").alias(v) for v in values))


def box_mean(df: DataFrame, values: Sequence[str], win: int, tile: int | None = None) -> DataFrame:
    """(keys, values): mean over win x win of what is present, edges repeated."""
    return _smoothed(df, values, lambda cells, line, pos, cols: box_pass(cells, ["region", line], pos, cols, win, tile))


def gaussian_smooth_2d(df: DataFrame, value: str, sigma: float, name: str = "smooth") -> DataFrame:
    lo, weights = gaussian_weights(sigma)
    made = _smoothed(df, [value], lambda cells, line, pos, cols: line_pass(cells, ["region", line], pos, cols, lo, weights, "wrap")).withColumnRenamed(value, name)
    return df.join(made, list(KEYS))


def top_position_index(df: DataFrame, sigma: float, elevation: str = "dem10m", name: str = "tpi") -> DataFrame:
    out = gaussian_smooth_2d(df, elevation, sigma, "_g")
    return out.withColumn(name, F.col(elevation) - F.col("_g")).drop("_g")


def gradient_slope(df: DataFrame, elevation: str = "dem10m", swap_steps: bool = False) -> DataFrame:
    """Adds slope_x and slope_y in radians: central differences inside, one-sided at the ends, over the
    mean step of the axis. `swap_steps` divides each by the other axis's step, as the published
    feature files do."""
    def along(line: str, pos: str) -> Column:
        w = Window.partitionBy("region", line).orderBy(pos)
        before, after, here = F.lag(elevation).over(w), F.lead(elevation).over(w), F.col(elevation)
        first, last = F.lag(pos).over(w).isNull(), F.lead(pos).over(w).isNull()
        return F.when(first, after - here).when(last, here - before).otherwise((after - before) / 2.0)

    steps = df.groupBy("region").agg(
        F.try_divide(F.max_by("x", "ix") - F.min_by("x", "ix"), F.max("ix") - F.min("ix")).alias("_dx"),
        F.try_divide(F.max_by("y", "iy") - F.min_by("y", "iy"), F.max("iy") - F.min("iy")).alias("_dy"),
    )
    dx, dy = ("_dy", "_dx") if swap_steps else ("_dx", "_dy")
    out = df.withColumns({"_gx": along("iy", "ix"), "_gy": along("ix", "iy")}).join(steps, "region")
    slopes = {"slope_x": F.atan(F.try_divide("_gx", dx)), "slope_y": F.atan(F.try_divide("_gy", dy))}
    return out.withColumns(slopes).drop("_gx", "_gy", "_dx", "_dy")


def kernel_smooth(df: DataFrame, values: Sequence[str], n: int) -> DataFrame:
    """(keys, values): convolution with a normalised Blackman product, zeros outside, nulls spread
    wherever the kernel reaches, zero weights included."""
    lo, weights = blackman_weights(n)
    out = line_pass(df.select(*KEYS, *values), ["region", "iy"], "ix", values, lo, weights, "zero")
    return line_pass(out, ["region", "ix"], "iy", values, lo, weights, "zero")


def slope_aspect(df: DataFrame, twice: bool = False) -> DataFrame:
    """Slope and aspect in degrees from slope_x, slope_y in radians; `twice` converts the component
    slopes to degrees a second time, as the published feature files do."""
    sx, sy = F.col("slope_x"), F.col("slope_y")
    aspect = F.pmod(F.degrees(F.atan2(sx, sy)) + 360.0, F.lit(360.0))
    deg = (lambda c: F.degrees(F.degrees(c))) if twice else F.degrees
    return df.withColumns({
        "slope_degrees": F.degrees(F.atan(F.hypot(sx, sy))), "aspect_degrees": aspect,
        "aspect_sin": F.sin(F.radians(aspect)), "aspect_cos": F.cos(F.radians(aspect)),
        "slope_x_degrees": deg(sx), "slope_y_degrees": deg(sy),
    })


FEATURES = ("slope_degrees", "slope_x_degrees", "slope_y_degrees", "aspect_degrees", "aspect_cos", "aspect_sin", "top_posn_idx")


def terrain_features(df: DataFrame, win: int, elevation: str = "dem10m", swap_steps: bool = False, twice: bool = False) -> DataFrame:
    """Adds slope, aspect and position index at one scale, null where the elevation is."""
    sloped = gradient_slope(df, elevation, swap_steps).select(*KEYS, "slope_x", "slope_y")
    made = slope_aspect(kernel_smooth(sloped, ["slope_x", "slope_y"], win), twice)
    out = top_position_index(df, win, elevation, "top_posn_idx").join(made.drop("slope_x", "slope_y"), list(KEYS))
    there = F.col(elevation).isNotNull()
    return out.withColumns({f: F.when(there, F.col(f)) for f in FEATURES}).withColumnsRenamed({f: f"{f}_w{win}" for f in FEATURES})


def ruggedness(df: DataFrame, win: int, elevation: str = "dem10m") -> DataFrame:
    """Adds tri_w: the mean distance of cells from their local mean."""
    near = df.select(*KEYS, elevation).join(box_mean(df, [elevation], win).withColumnRenamed(elevation, "_m"), list(KEYS))
    tri = box_mean(near.withColumn("_t", F.abs(F.col(elevation) - F.col("_m"))), ["_t"], win)
    return df.join(tri.withColumnRenamed("_t", f"tri_w{win}"), list(KEYS))


def _normals(slope: str, aspect: str) -> dict[str, Column]:
    s, a = F.radians(slope), F.radians(aspect)
    return {"nx": F.sin(s) * F.cos(a), "ny": F.sin(s) * F.sin(a), "nz": F.when(F.col(aspect).isNotNull() | F.col(slope).isNotNull(), F.cos(s))}


def _vrm() -> Column:
    return 1 - F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))


def vector_ruggedness(df: DataFrame, win: int, slope: str, aspect: str) -> DataFrame:
    """Adds vrm_w: one less the length of the mean unit normal."""
    normal = _normals(slope, aspect)
    mean = box_mean(df.select(*KEYS, *(c.alias(n) for n, c in normal.items())), list(normal), win)
    return df.join(mean.select(*KEYS, _vrm().alias(f"vrm_w{win}")), list(KEYS))


def multiscale_contrasts(df: DataFrame, small: int = 3, large: int = 50) -> DataFrame:
    """Differences of features between two scales, for those present at both."""
    has = lambda f: all(f"{f}_w{w}" in df.columns for w in (small, large))
    apart = lambda f: F.col(f"{f}_w{small}") - F.col(f"{f}_w{large}")
    new = {}
    if has("slope_degrees"):
        new[f"slope_diff_w{small}_w{large}"] = apart("slope_degrees")
    if has("aspect_cos") and has("aspect_sin"):
        new[f"aspect_vecdiff_w{small}_w{large}"] = F.hypot(apart("aspect_cos"), apart("aspect_sin"))
    if has("top_posn_idx"):
        new[f"tpi_diff_w{small}_w{large}"] = apart("top_posn_idx")
    return df.withColumns(new) if new else df


_POOLING = ("norm_height", "mbi", "svf")


def _pooled(parts: Sequence[str]) -> Column:
    """Mean z-score of the pooling parts, whose statistics are there as _<part>."""
    z = []
    for c in parts:
        if c == "svf":  # the z-score of one less the min-max of svf, from the statistics of svf
            width = F.col("_svf_hi") - F.col("_svf_lo") + _TINY
            z.append(-(F.col("_svf") - F.col("_svf_m")) / width / (F.col("_svf_s") / width + _TINY))
        else:  # of the value with its sign changed
            z.append(-_z(f"_{c}"))
    return sum(z[1:], z[0]) / len(z)


def _cold() -> Column:
    """Cold bias before scaling, from the statistics of _p and _e; the z-score of the pooling index is
    that of _p, but for its scale."""
    width = F.col("_p_hi") - F.col("_p_lo") + _TINY
    return (F.col("_p") - F.col("_p_m")) / width / (F.col("_p_s") / width + _TINY) + 0.5 * _z("_e")


def _pooling(df: DataFrame, more: Mapping[str, Column]) -> DataFrame:
    """Adds _p, the mean z-score of the pooling parts that are present, with its statistics and those
    of the `more` columns: two levels of statistics."""
    parts = [c for c in _POOLING if c in df.columns]
    if not parts:
        raise ValueError("one of norm_height, mbi, svf is needed")
    out = with_stats(df, {f"_{c}": F.col(c) for c in parts})
    return with_stats(_without_stats(out.withColumn("_total", _pooled(parts)), *(f"_{c}" for c in parts)), {"_p": F.col("_total"), **more}).drop("_total")


def cold_air_pooling(df: DataFrame, name: str = "capi") -> DataFrame:
    """0..1 from low relative height, valley tendency and enclosure, those that are present."""
    return _without_stats(_pooling(df, {}).withColumn(name, _n("_p")), "_p")


def openness(df: DataFrame, win: int = 25, elevation: str = "dem10m") -> DataFrame:
    if elevation not in df.columns:
        raise ValueError(f"{elevation} is needed")
    out = df.join(box_mean(df, [elevation], win).withColumnRenamed(elevation, "_m"), list(KEYS))
    wanted = {"_relief": F.abs(F.col(elevation) - F.col("_m"))} | ({"_sky": F.col("svf")} if "svf" in df.columns else {})
    out = with_stats(out, wanted)
    sky = _n("_sky") if "_sky" in wanted else F.lit(0.5)
    return _without_stats(out.withColumn(f"openness_proxy_w{win}", 0.5 * sky + 0.5 * _n("_relief")).drop("_m"), *wanted)


def cold_bias(df: DataFrame, elevation: str = "dem10m", name: str = "cold_bias_potential") -> DataFrame:
    if elevation not in df.columns:
        raise ValueError(f"{elevation} is needed")
    out = _pooling(df, {"_e": F.col(elevation)})
    out = _without_stats(out.withColumn("_b", _cold()), "_p", "_e")
    out = with_stats(out, {"_c": F.col("_b")})
    return _without_stats(out.withColumn(name, _n("_c")).drop("_b"), "_c")


def solar_factor(df: DataFrame, times: DataFrame, cell: Sequence[str] = KEYS) -> DataFrame:
    """Monthly potential radiation over the region's largest of that month, for each time's month."""
    months = [m for m in range(1, 13) if f"pisr_{m}" in df.columns]
    if not months:
        raise ValueError("no pisr_1..pisr_12")
    long = df.select(*cell, F.explode(F.array(*(F.struct(F.lit(m).alias("month"), F.col(f"pisr_{m}").alias("p")) for m in months))).alias("m")).select(*cell, "m.*")
    top = long.groupBy("region", "month").agg(F.max("p").alias("_top"))
    factor = long.join(top, ["region", "month"]).select(*cell, "month", (F.col("p") / (F.col("_top") + _TINY)).alias("solar_factor"))
    return times.withColumn("month", F.month("time")).join(factor, "month").drop("month")


def wind_on_slope(df: DataFrame, speed: str, direction: str, aspect: str) -> DataFrame:
    """Components of the wind (direction it comes from) along the slope, up being positive, and across."""
    turned = lambda c: F.pmod(F.col(c) + 180.0, F.lit(360.0))
    theta = F.radians(F.pmod(turned(direction) - turned(aspect), F.lit(360.0)))
    return df.withColumns({"wind_along_slope": F.col(speed) * F.cos(theta), "wind_cross_slope": F.col(speed) * F.sin(theta)})


def wind_exposure(df: DataFrame, index: str = "windexp500", name: str = "wind_shelter_exposure") -> DataFrame:
    """Min-max of the index, turned round first where less than half of the cells are above zero; null
    cells count as not above."""
    above = F.coalesce((F.col(index) > 0).cast("double"), F.lit(0.0))
    out = with_stats(df, {"_i": F.col(index), "_a": above})
    width = F.col("_i_hi") - F.col("_i_lo") + _TINY
    turned = (F.col("_i_hi") - F.col("_i")) / width
    return _without_stats(out.withColumn(name, F.when(F.col("_a_m") < 0.5, turned).otherwise(_n("_i"))), "_i", "_a")


def effective_wind(df: DataFrame, speed: str, index: str = "windexp500", k: float = 0.6) -> DataFrame:
    out = wind_exposure(df, index, "_e")
    return out.withColumn("wind_speed_effective", F.col(speed) * ((1 - k) + k * F.col("_e"))).drop("_e")


def static_predictors(df: DataFrame, scales: Sequence[int] = (3, 50)) -> DataFrame:
    """All static features that the present columns allow: contrasts between the scales, ruggedness,
    openness and vector ruggedness at each, cold-air pooling and cold bias. Of each scale all local
    means are taken in one pass and written, then those of the distances from them; three levels of
    statistics serve all features."""
    base = multiscale_contrasts(df, *scales)
    high = "dem10m" in df.columns
    means = None
    for w in scales:
        slope, aspect = f"slope_degrees_w{w}", f"aspect_degrees_w{w}"
        sloped = {slope, aspect} <= set(df.columns)
        if not high and not sloped:
            continue
        normal = _normals(slope, aspect) if sloped else {}
        made = box_mean(df.select(*KEYS, *(["dem10m"] if high else []), *(c.alias(n) for n, c in normal.items())), [*(["dem10m"] if high else []), *normal], w)
        made = made.select(*KEYS, *([F.col("dem10m").alias(f"_m_w{w}")] if high else []), *([_vrm().alias(f"vrm_w{w}")] if sloped else []))
        means = made if means is None else means.join(made, list(KEYS))
    if means is not None:
        base = base.join(settle(means, "means"), list(KEYS))
    if high:
        apart = {f"_t_w{w}": F.abs(F.col("dem10m") - F.col(f"_m_w{w}")) for w in scales}
        base = base.withColumns(apart).drop(*(f"_m_w{w}" for w in scales))
        tri = None
        for w in scales:
            made = box_mean(base.select(*KEYS, f"_t_w{w}"), [f"_t_w{w}"], w).withColumnRenamed(f"_t_w{w}", f"tri_w{w}")
            tri = made if tri is None else tri.join(made, list(KEYS))
        base = settle(base.join(tri, list(KEYS)), "rugged")
    parts = [c for c in _POOLING if c in df.columns]
    wanted = {f"_{c}": F.col(c) for c in parts}
    if high:
        wanted |= {f"_relief_w{w}": F.col(f"_t_w{w}") for w in scales} | ({"_svf": F.col("svf")} if "svf" in df.columns else {})
    if wanted:
        base = with_stats(base, wanted)
    if high:
        sky = _n("_svf") if "svf" in df.columns else F.lit(0.5)
        base = base.withColumns({f"openness_proxy_w{w}": 0.5 * sky + 0.5 * _n(f"_relief_w{w}") for w in scales}).drop(*(f"_t_w{w}" for w in scales))
    if parts:
        base = base.withColumn("_total", _pooled(parts))
    base = _without_stats(base, *wanted)
    if not parts:
        return base
    base = with_stats(base, {"_p": F.col("_total")} | ({"_e": F.col("dem10m")} if high else {})).drop("_total").withColumn("capi", _n("_p"))
    if not high:
        return _without_stats(base, "_p")
    base = _without_stats(base.withColumn("_b", _cold()), "_p", "_e")
    return _without_stats(with_stats(base, {"_c": F.col("_b")}).withColumn("cold_bias_potential", _n("_c")).drop("_b"), "_c")


def hourly_predictors(static: DataFrame, hourly: DataFrame, swdown: str | None = None, speed: str | None = None, direction: str | None = None, aspect: str | None = None) -> DataFrame:
    """Solar factor, shortwave times it, effective wind and wind along slopes at every hour; `hourly`
    has region, time and the forcing columns."""
    out = hourly.join(static, "region")
    if any(f"pisr_{m}" in static.columns for m in range(1, 13)):
        factor = solar_factor(static, hourly.select("time").distinct())
        out = out.join(factor, [*KEYS, "time"])
        if swdown:
            out = out.withColumn("swdown_effective", F.col(swdown) * F.col("solar_factor"))
    if speed and "windexp500" in static.columns:
        exposure = wind_exposure(static).select(*KEYS, "wind_shelter_exposure")
        out = out.join(exposure, list(KEYS)).withColumn("wind_speed_effective", F.col(speed) * (0.4 + 0.6 * F.col("wind_shelter_exposure")))
    return wind_on_slope(out, speed, direction, aspect) if speed and direction and aspect else out



def fill_grid(df: DataFrame) -> DataFrame:
    """Every cell of each region's rectangle; cells that were absent have nulls."""
    span = df.groupBy("region").agg(F.min("iy").alias("a"), F.max("iy").alias("b"), F.min("ix").alias("c"), F.max("ix").alias("e"))
    rows = span.select("region", "c", "e", F.explode(F.sequence("a", "b")).alias("iy"))
    return rows.select("region", "iy", F.explode(F.sequence("c", "e")).alias("ix")).join(df, list(KEYS), "left")

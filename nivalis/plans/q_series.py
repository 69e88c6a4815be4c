"""Queries over readings and series: sources, selection, aggregates, indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from nivalis.functions import timecols
from nivalis.operators import aggregate as A
from nivalis.operators import bioclim as B
from nivalis.operators import interpolate as I
from nivalis.operators import select as P
from nivalis.operators import series as S
from nivalis.plans.registry import register
from nivalis.sources import io

T = ["T1", "T2", "T3"]
R = ["readings"]
MODELS = ["gbt_T3", "lasso_T3", "physical_T3", "coarse_T3"]

# ---- sources
register(
    "s01_read_readings", lambda g: io.standard_readings(g("readings").withColumnRenamed("time", "datetime")),
    "SELECT row_id, site, region, time, T1, T2, T3 FROM readings", R, keys="region", times="time", ints="row_id site", vals="T1 T2 T3",
)
register(
    "s02_read_many", lambda g: _read_many(g).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")),
    "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1", keys="l_returnflag", ints="n", vals="q",
)


def _read_many(g):
    path = g("lineitem").inputFiles()[0]
    folder = path.rpartition("lineitem.parquet")[0]
    return io.read_many(g("lineitem").sparkSession, [f"{folder}lineitem.parquet", f"{folder}absent_year.parquet"])


register(
    "s03_merge_variables",
    lambda g: io.merge_variables([g("reanalysis").filter("t2m < 270").select("time", "lat", "lon", "t2m"), g("reanalysis").filter("skt > 277").select("time", "lat", "lon", "skt"), g("reanalysis").select("time", "lat", "lon", "d2m").filter("lat > 66")]),
    """SELECT coalesce(coalesce(a.time, b.time), c.time) AS time, coalesce(coalesce(a.lat, b.lat), c.lat) AS lat, coalesce(coalesce(a.lon, b.lon), c.lon) AS lon, t2m, skt, d2m
    FROM (SELECT * FROM reanalysis WHERE t2m < 270) a FULL JOIN (SELECT time, lat, lon, skt AS skt FROM reanalysis WHERE skt > 277) b ON a.time = b.time AND a.lat = b.lat AND a.lon = b.lon
    FULL JOIN (SELECT time, lat, lon, d2m FROM reanalysis WHERE lat > 66) c ON c.time = coalesce(a.time, b.time) AND c.lat = coalesce(a.lat, b.lat) AND c.lon = coalesce(a.lon, b.lon)""".replace("t2m, skt, d2m\n", "a.t2m AS t2m, b.skt AS skt, c.d2m AS d2m\n"),
    ["reanalysis"], times="time", vals="lat lon t2m skt d2m",
)
register(
    "s03_grid_to_long", lambda g: io.grid_to_long(g("reanalysis").select("time", "lat", "lon", "t2m", "skt"), ["time", "lat", "lon"]),
    "SELECT time, lat, lon, 't2m' AS variable, t2m AS value FROM reanalysis UNION ALL SELECT time, lat, lon, 'skt', skt FROM reanalysis",
    ["reanalysis"], keys="variable", times="time", vals="lat lon value",
)
register(
    "s04_normalise_coords",
    lambda g: io.normalise_coords(g("reanalysis").select("time", F.col("lat").alias("latitude"), (F.col("lon") * 15).alias("longitude"), "t2m")),
    "SELECT time, lat, CASE WHEN lon * 15 >= 180 THEN lon * 15 - 360 ELSE lon * 15 END AS lon, t2m FROM reanalysis", ["reanalysis"], times="time", vals="lat lon t2m",
)
register(
    "s05_assemble_predictors",
    lambda g: io.assemble_predictors(
        g("skill").select("region", "site", "time", "T3"), g("skill").filter("coarse_T3 < 5").select("region", "site", "time", F.col("coarse_T3").alias("E5_skt"), "T3"),
        g("sites").select("region", "site", F.col("x").alias("St_x"), F.col("lat").alias("St_lat")),
    ),
    "SELECT k.region, k.site, k.time, k.T3, CASE WHEN k.coarse_T3 < 5 THEN k.coarse_T3 END AS E5_skt, s.x AS St_x, s.lat AS St_lat FROM skill k LEFT JOIN sites s ON k.site = s.site AND k.region = s.region",
    ["skill"], keys="region", times="time", ints="site", vals="T3 E5_skt St_x St_lat",
)
register(
    "s06_nan_to_null",
    lambda g: io.nan_to_null(g("readings").select("row_id", F.when(F.col("row_id") % 5 == 0, F.lit(float("nan"))).when(F.col("row_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("T3")).alias("T3"), "T2"), ["T3", "T2"]),
    "SELECT row_id, CASE WHEN row_id % 5 <> 0 AND row_id % 7 <> 0 THEN T3 END AS T3, T2 FROM readings", R, ints="row_id", vals="T2 T3",
)
register("s07_scale_packed", lambda g: io.scale_packed(g("readings").select("row_id", (F.col("row_id") * 7).alias("packed")), ["packed"]), "SELECT row_id, row_id * 7 / 100e0 AS packed FROM readings", R, ints="row_id", vals="packed")
register(
    "w02_cube_from_points", lambda g: io.cube_from_points(g("reanalysis").select("time", F.col("lat").alias("y"), F.col("lon").alias("x"), F.col("skt").alias("value")), 3, pivot=True).select("time", "y", F.col("`20.0`").alias("x20"), F.col("`28.0`").alias("x28")),
    "SELECT time, lat AS y, max(CASE WHEN lon = 20 THEN skt END) AS x20, max(CASE WHEN lon = 28 THEN skt END) AS x28 FROM reanalysis WHERE month(time) = 3 GROUP BY 1, 2", ["reanalysis"], times="time", vals="y x20 x28",
)

# ---- selection
register("p01_valid_readings", lambda g: P.valid_readings(g("readings")), "SELECT row_id, T3 FROM readings WHERE error_tomst = 0", R, ints="row_id", vals="T3")
register(
    "p02_exclude_box", lambda g: P.exclude_box(g("sites"), "ASIA", "x", 2000, 6000),
    "SELECT site, region, x FROM sites WHERE NOT (region = 'ASIA' AND x > 2000 AND x < 6000)", ["sites"], keys="region", ints="site", vals="x",
)
register("p03_drop_incomplete", lambda g: P.drop_incomplete(g("readings"), ["T1", "T2", "T3"]), "SELECT row_id, T2 FROM readings WHERE T1 IS NOT NULL AND T2 IS NOT NULL AND T3 IS NOT NULL", R, ints="row_id", vals="T2")
register(
    "p04_drop_empty_columns", lambda g: P.drop_empty_columns(g("skill"), "region", ["T3", "physical_T3", "gbt_T3"]),
    "c AS (SELECT region, count(physical_T3) AS n FROM skill GROUP BY 1)\n--\nSELECT k.region, site, time, T3, physical_T3 FROM skill k JOIN c ON k.region = c.region WHERE (physical_T3 IS NOT NULL OR n = 0) AND T3 IS NOT NULL AND gbt_T3 IS NOT NULL",
    ["skill"], keys="region", times="time", ints="site", vals="T3 physical_T3",
)
register("p05_bbox", lambda g: P.bbox(g("sites")), "SELECT region, min(x) - 500 AS x0, max(x) + 500 AS x1, min(y) - 500 AS y0, max(y) + 500 AS y1 FROM sites GROUP BY 1", ["sites"], keys="region", vals="x0 x1 y0 y1")
register(
    "p05_clip_to_box", lambda g: P.clip_to_box(g("sites"), P.bbox(g("sites").filter("x between 2000 and 6000"), 0.0)),
    "b AS (SELECT region, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM sites WHERE x BETWEEN 2000 AND 6000 GROUP BY 1)\n--\nSELECT s.region, site, x, y FROM sites s JOIN b ON s.region = b.region WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1",
    ["sites"], keys="region", ints="site", vals="x y",
)
register("p06_complete_cells", lambda g: P.complete_cells(g("dem"), ["dem10m", "svf"]), "SELECT region, iy, ix, dem10m FROM dem WHERE dem10m IS NOT NULL AND svf IS NOT NULL", ["dem"], keys="region", ints="iy ix", vals="dem10m")
register("p06_complete_mask", lambda g: P.complete_mask(g("dem"), ["dem10m"]), "SELECT region, iy, ix, CASE WHEN dem10m IS NOT NULL THEN 1 END AS mask FROM dem", ["dem"], keys="region", ints="iy ix mask")
register(
    "p07_half_plane_mask", lambda g: P.half_plane_mask(g("dem"), (0.0, -20.0), (490.0, -150.0), ["dem10m"]),
    "SELECT region, iy, ix, y FROM dem WHERE y < (-130e0 / 490e0) * x - 20 AND dem10m IS NOT NULL", ["dem"], keys="region", ints="iy ix", vals="y",
)
register(
    "p08_thin_grid", lambda g: P.thin_grid(g("dem").select("iy", "ix").distinct(), 130),
    "SELECT DISTINCT iy, ix FROM dem WHERE iy % k = 0 AND ix % k = 0".replace("% k", "% 3"), ["dem"], ints="iy ix",
)
register(
    "p09_select_time", lambda g: P.select_time(g("reanalysis"), g("skill").filter("day(time) = 1")),
    "SELECT time, lat, lon, t2m FROM reanalysis WHERE time IN (SELECT time FROM skill WHERE day(time) = 1)", ["reanalysis", "skill"], times="time", vals="lat lon t2m",
)
register(
    "p10_padded_month_range", lambda g: P.padded_month_range(g("region").sparkSession, 2024, 2).join(g("readings").select(F.date_trunc("hour", "time").alias("h")).distinct(), F.col("time") == F.col("h"), "left").select("time", F.col("h").isNotNull().cast("int").alias("seen")),
    "h AS (SELECT DISTINCT date_trunc('hour', time) AS h FROM readings)\n--\nSELECT t AS time, CASE WHEN h IS NULL THEN 0 ELSE 1 END AS seen FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-31 20:00:00', TIMESTAMP '2024-03-01 03:00:00', INTERVAL 1 HOUR)) AS t) LEFT JOIN h ON t = h",
    R, times="time", ints="seen",
)
register(
    "p11_site_sample", lambda g: P.site_sample(g("sites"), 5, 99),
    "SELECT region, site FROM (SELECT region, site, row_number() OVER (PARTITION BY region ORDER BY md5(concat(CAST(site AS VARCHAR), '|99')), site) AS k FROM sites) WHERE k <= 5", ["sites"], keys="region", ints="site",
)
register("p12_min_distance_sample", lambda g: P.min_distance_sample(g("sites").select("site", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), 2500.0), None, ["sites"], ints="site", vals="x y")
register(
    "p13_row_sample", lambda g: P.row_sample(g("readings"), 500, ["row_id"], 99),
    "SELECT row_id, T3 FROM readings ORDER BY md5(concat(CAST(row_id AS VARCHAR), '|99')), row_id LIMIT 500", R, ints="row_id", vals="T3",
)
register(
    "p14_month_group", lambda g: P.month_group(g("skill")).groupBy("month_group", "region").agg(F.count("*").alias("n"), F.avg("T3").alias("T3")),
    "SELECT m.g AS month_group, region, count(*) AS n, avg(T3) AS T3 FROM skill JOIN (VALUES ('ALL', 1, 12), ('SUMMER', 5, 9)) m(g, a, b) ON month(time) BETWEEN a AND b GROUP BY 1, 2", ["skill"], keys="month_group region", ints="n", vals="T3",
)
register("p15_prefix_columns", lambda g: io.select_prefix(io.prefix_columns(g("dem"), "St_", ["region", "iy", "ix"]), ["St_d", "St_s"], ["region", "iy", "ix"]), "SELECT region, iy, ix, dem10m AS St_dem10m, svf AS St_svf FROM dem", ["dem"], keys="region", ints="iy ix", vals="St_dem10m St_svf")
register(
    "p16_require_coverage", lambda g: P.require_coverage(g("skill").groupBy("site").agg(F.count("physical_T3").alias("err_count"), F.count("T3").alias("obs_count")), 50),
    "SELECT site, count(physical_T3) AS err_count, count(T3) AS obs_count FROM skill GROUP BY 1 HAVING count(physical_T3) >= 50 AND count(T3) >= 50", ["skill"], ints="site err_count obs_count",
)
register("p17_clip_metric", lambda g: P.clip_metric(g("readings"), ["T3"], -2, 12), "SELECT row_id, CASE WHEN T3 > -2 AND T3 < 12 THEN T3 END AS T3 FROM readings", R, ints="row_id", vals="T3")
register("p18_filter_by", lambda g: P.filter_by(g("readings"), {"region": ["click", "view", "purchase"], "error_tomst": 0}, "T2"), "SELECT row_id, T2 FROM readings WHERE region IN ('click', 'view', 'purchase') AND error_tomst = 0 AND T2 IS NOT NULL", R, ints="row_id", vals="T2")

# ---- joins
register("j01_attach_site_coords", lambda g: I.attach_site_coords(g("readings"), g("sites")), "SELECT r.row_id, s.x, s.lat FROM readings r LEFT JOIN sites s ON r.site = s.site", ["readings", "sites"], ints="row_id", vals="x lat")
# means of other summation orders differ by rounding, so values apart by less than 1e-9 are equal on both sides
register(
    "j02_attach_model", lambda g: I.attach_model(g("skill").select("region", "site", "time", "T3"), g("skill").filter("gbt_T3 - T3 > 1e-9").select("region", "site", "time", F.col("gbt_T3").alias("m")), ["region", "site", "time"]),
    "SELECT site, time, T3, CASE WHEN gbt_T3 - T3 > 1e-9 THEN gbt_T3 END AS m FROM skill", ["skill"], times="time", ints="site", vals="T3 m",
)
register(
    "j03_expand_static", lambda g: I.expand_static(g("reanalysis").groupBy("lat", "lon").agg(F.max("skt").alias("high")), g("reanalysis").select("time", "lat", "lon", "t2m"), ["lat", "lon"]),
    "SELECT time, lat, lon, t2m, max(skt) OVER (PARTITION BY lat, lon) AS high FROM reanalysis", ["reanalysis"], times="time", vals="lat lon t2m high",
)
register("j05_broadcast_group_stat", lambda g: I.broadcast_group_stat(g("skill"), ["site"], "T3", F.avg, "apart"), "SELECT site, time, T3 - avg(T3) OVER (PARTITION BY site) AS apart FROM skill", ["skill"], times="time", ints="site", vals="apart")

# ---- aggregates
HOURLY = "hourly AS (SELECT site, date_trunc('hour', time) AS time, median(T1) AS T1, median(T2) AS T2, median(T3) AS T3, min(row_id) AS row_id FROM readings WHERE error_tomst = 0 GROUP BY 1, 2)"
register("a01_hourly_median", lambda g: A.hourly_median(P.valid_readings(g("readings")), T, ident="row_id"), HOURLY + "\n--\nSELECT * FROM hourly", R, times="time", ints="site row_id", vals="T1 T2 T3")
register("a02_site_means", lambda g: A.site_means(g("skill")), "SELECT site, avg(x) AS x, avg(y) AS y, avg(lon) AS lon, avg(lat) AS lat FROM skill GROUP BY 1", ["skill"], ints="site", vals="x y lon lat")
register(
    "a03_time_and_cell_means", lambda g: A.time_and_cell_means(g("reanalysis"), "t2m"),
    "SELECT time, NULL AS lat, NULL AS lon, avg(t2m) AS t2m, 'time' AS level FROM reanalysis GROUP BY 1 UNION ALL SELECT NULL, lat, lon, avg(t2m), 'cell' FROM reanalysis GROUP BY lat, lon", ["reanalysis"], keys="level", times="time", vals="lat lon t2m",
)
register("a04_daily_mean", lambda g: A.daily_mean(g("readings"), T).withColumn("date", F.col("date").cast("timestamp")), "SELECT region, site, date_trunc('day', time) AS date, avg(T1) AS T1, avg(T2) AS T2, avg(T3) AS T3 FROM readings GROUP BY 1, 2, 3", R, keys="region", times="date", ints="site", vals="T1 T2 T3")
DAILY = "daily AS (SELECT region, date_trunc('day', time) AS date, min(T3) AS T3_min, avg(T3) AS T3_mean, max(T3) AS T3_max FROM skill GROUP BY 1, 2)"
register("a05_daily_min_mean_max", lambda g: A.daily_min_mean_max(g("skill"), ["T3"]).withColumn("date", F.col("date").cast("timestamp")), DAILY + "\n--\nSELECT * FROM daily", ["skill"], keys="region", times="date", vals="T3_min T3_mean T3_max")
DOY = "CASE WHEN month(date) = 2 AND day(date) = 29 THEN NULL WHEN (year(date) % 4 = 0 AND year(date) % 100 <> 0 OR year(date) % 400 = 0) AND dayofyear(date) > 60 THEN dayofyear(date) - 1 ELSE dayofyear(date) END"
register(
    "a06_daily_climatology", lambda g: A.daily_climatology(g("skill"), ["T3"]),
    DAILY + f"\n--\nSELECT region, {DOY} AS doy, avg(T3_min) AS T3_min, avg(T3_mean) AS T3_mean, avg(T3_max) AS T3_max FROM daily WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY 1, 2", ["skill"], keys="region", ints="doy", vals="T3_min T3_mean T3_max",
)
RANGE = "rng AS (SELECT region, date_trunc('hour', time) AS time, max(T3) - min(T3) AS T3, max(physical_T3) - min(physical_T3) AS physical_T3 FROM skill GROUP BY 1, 2)"
RDAY = RANGE + ", rday AS (SELECT region, date_trunc('day', time) AS date, avg(T3) AS T3, avg(physical_T3) AS physical_T3 FROM rng GROUP BY 1, 2)"
register("a07_spatial_range_hourly", lambda g: A.spatial_range_hourly(g("skill"), ["T3", "physical_T3"]), RANGE + "\n--\nSELECT * FROM rng", ["skill"], keys="region", times="time", vals="T3 physical_T3")
register("a08_spatial_range_daily", lambda g: A.spatial_range_daily(g("skill"), ["T3", "physical_T3"]).withColumn("date", F.col("date").cast("timestamp")), RDAY + "\n--\nSELECT * FROM rday", ["skill"], keys="region", times="date", vals="T3 physical_T3")
register(
    "a09_spatial_range_climatology", lambda g: A.spatial_range_climatology(g("skill"), ["T3", "physical_T3"]),
    RDAY + f"\n--\nSELECT region, {DOY} AS doy, avg(T3) AS T3, avg(physical_T3) AS physical_T3 FROM rday WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY 1, 2", ["skill"], keys="region", ints="doy", vals="T3 physical_T3",
)
register(
    "a10_hour_of_year_summary", lambda g: A.hour_of_year_summary(g("readings"), ["T3"]),
    f"SELECT region, ({DOY.replace('date', 'time')} - 1) * 24 + hour(time) AS hoy, min(T3) AS T3_min, avg(T3) AS T3_mean, max(T3) AS T3_max FROM readings WHERE NOT (month(time) = 2 AND day(time) = 29) GROUP BY 1, 2", R, keys="region", ints="hoy", vals="T3_min T3_mean T3_max",
)
ANOM = "anom AS (SELECT r.*, skt - m AS anomaly FROM reanalysis r JOIN (SELECT time, median(skt) AS m FROM reanalysis GROUP BY 1) USING (time))"
register("a11_spatial_anomaly", lambda g: A.spatial_anomaly(g("reanalysis"), "skt"), ANOM + "\n--\nSELECT time, lat, lon, anomaly FROM anom", ["reanalysis"], times="time", vals="lat lon anomaly")
register("a12_median_anomaly_map", lambda g: A.median_anomaly_map(g("reanalysis"), "skt", ["lat", "lon"]), ANOM + "\n--\nSELECT lat, lon, median(anomaly) AS anomaly FROM anom GROUP BY 1, 2", ["reanalysis"], vals="lat lon anomaly")
register(
    "a13_temporal_anomaly", lambda g: A.temporal_anomaly(g("reanalysis"), "skt", ["lat", "lon"]),
    "SELECT time, lat, lon, skt - m AS anomaly FROM reanalysis r JOIN (SELECT lat AS la, lon AS lo, month(time) AS mo, median(skt) AS m FROM reanalysis GROUP BY 1, 2, 3) ON lat = la AND lon = lo AND month(time) = mo", ["reanalysis"], times="time", vals="lat lon anomaly",
)
register(
    "a14_seasonal_anomaly_map", lambda g: A.seasonal_anomaly_map(g("reanalysis"), "skt", ["lat", "lon"]),
    ANOM + "\n--\nSELECT CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) < 6 THEN 'MAM' WHEN month(time) < 9 THEN 'JJA' ELSE 'SON' END AS season, lat, lon, median(anomaly) AS anomaly FROM anom GROUP BY 1, 2, 3", ["reanalysis"], keys="season", vals="lat lon anomaly",
)
register("a18_histogram", lambda g: A.histogram(g("readings"), "T3", 12, -7.0, 20.0, ["region"], True), """SELECT region, b AS bin, n, n / nullif(sum(n) OVER (PARTITION BY region) * 2.25e0, 0) AS density FROM (SELECT r.region, b.b, count(h.region) AS n FROM (SELECT DISTINCT region FROM readings) r CROSS JOIN (SELECT unnest(range(12)) AS b) b
LEFT JOIN readings h ON h.region = r.region AND h.T3 BETWEEN -7 AND 20 AND least(CAST(floor((h.T3 + 7) / 2.25e0) AS INT), 11) = b.b GROUP BY 1, 2)""", R, keys="region", ints="bin n", vals="density")
register(
    "a19_hist2d", lambda g: A.hist2d(g("skill"), "T3", "gbt_T3"),
    """e AS (SELECT least(min(T3), min(gbt_T3)) - 0.5e0 AS lo, greatest(max(T3), max(gbt_T3)) + 0.5e0 AS hi FROM skill)
--
SELECT CAST(floor((T3 - lo) / ((hi - lo) / 49)) AS INT) AS bx, CAST(floor((gbt_T3 - lo) / ((hi - lo) / 49)) AS INT) AS "by", count(*) AS n FROM skill, e GROUP BY 1, 2""", ["skill"], ints="bx by n",
)
register("a20_linear_fit", lambda g: A.linear_fit(g("skill"), "T3", "gbt_T3", ["region"]), "SELECT region, regr_slope(gbt_T3, T3) AS slope, regr_intercept(gbt_T3, T3) AS intercept FROM skill GROUP BY 1", ["skill"], keys="region", vals="slope intercept")
register("a21_box_stats", lambda g: A.box_stats(g("skill"), ["region"], "physical_T3"), "SELECT region, count(physical_T3) AS n, quantile_cont(physical_T3, 0.25) AS q1, quantile_cont(physical_T3, 0.5) AS median, quantile_cont(physical_T3, 0.75) AS q3 FROM skill GROUP BY 1", ["skill"], keys="region", ints="n", vals="q1 median q3")
register("a22_all_and_by_region", lambda g: A.all_and_by_region(g("skill"), F.avg("T3").alias("mean"), F.count("*").alias("n")), "SELECT region, avg(T3) AS mean, count(*) AS n FROM skill GROUP BY 1 UNION ALL SELECT 'all', avg(T3), count(*) FROM skill", ["skill"], keys="region", ints="n", vals="mean")
register("a23_top_groups", lambda g: A.top_groups(g("skill"), "site", "T3", 8), "SELECT site, count(T3) AS \"count\", median(T3) AS median, avg(T3) AS mean FROM skill GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", ["skill"], ints="site count", vals="median mean")
register(
    "a24_density_curve", lambda g: A.density_curve(g("skill"), "region", "T3", 60, 3.0),
    """e AS (SELECT min(T3) AS lo, max(T3) AS hi FROM skill), c AS (SELECT region, least(CAST(floor((T3 - lo) / ((hi - lo) / 60)) AS INT), 59) AS b, count(*) AS n FROM skill, e GROUP BY 1, 2),
s AS (SELECT region, b + k AS bin, sum(n * exp(-0.5e0 * power(k / 3e0, 2))) AS w FROM c, (SELECT unnest(range(-60, 61)) AS k) WHERE b + k BETWEEN 0 AND 59 GROUP BY 1, 2)
--
SELECT region, bin, w / max(w) OVER (PARTITION BY region) AS density FROM s""", ["skill"], keys="region", ints="bin", vals="density",
)
register(
    "a25_trial_summary", lambda g: A.trial_summary(g("orders").select(F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("value")).groupBy("number").agg(F.min("value").alias("value")))[1],
    "SELECT number, min(value) OVER (ORDER BY number) AS best_so_far FROM (SELECT o_orderkey AS number, min(o_totalprice) AS value FROM orders GROUP BY 1)", ints="number", vals="best_so_far",
)
register("a26_time_coverage", lambda g: A.time_coverage(g("readings")), "SELECT region, min(time) AS first, max(time) AS last, count(*) AS n FROM readings GROUP BY 1", R, keys="region", times="first last", ints="n")

# ---- indicators, on hourly medians
_hourly = lambda g: A.hourly_median(P.valid_readings(g("readings")), T, ident="row_id")
B3 = "b3 AS (SELECT site, sum(CASE WHEN f <> p THEN 1 ELSE 0 END) AS c, count(*) AS n FROM (SELECT site, T2 <= 0 AS f, lag(T2 <= 0) OVER (PARTITION BY site ORDER BY time) AS p FROM hourly WHERE T2 IS NOT NULL) GROUP BY 1)"
B4 = """b4 AS (SELECT site, count(*) AS k, avg(n) AS l FROM (SELECT site, g, count(*) AS n FROM (SELECT site, inside, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY time) AS g
FROM (SELECT site, time, coalesce(T2 >= -2 AND T2 <= 2, FALSE) AS inside FROM hourly)) WHERE inside GROUP BY 1, 2) GROUP BY 1)"""
register("b01_frost_hours", lambda g: B.frost_hours(_hourly(g), "T2", ["site"]), HOURLY + "\n--\nSELECT site, sum(CASE WHEN T2 <= 0 THEN 1 ELSE 0 END) AS frost_hours FROM hourly GROUP BY 1", R, ints="site frost_hours")
register("b02_degree_hours", lambda g: B.degree_hours(_hourly(g), "T2", ["site"], 1.0), HOURLY + "\n--\nSELECT site, sum(CASE WHEN T2 > 1 THEN T2 - 1 ELSE 0 END) AS degree_hours FROM hourly GROUP BY 1", R, ints="site", vals="degree_hours")
register("b03_freeze_thaw_cycles", lambda g: B.freeze_thaw_cycles(_hourly(g), "T2", ["site"]), f"{HOURLY}, {B3}\n--\nSELECT s.site, CASE WHEN n >= 2 THEN c END AS freeze_thaw FROM (SELECT DISTINCT site FROM hourly) s LEFT JOIN b3 ON s.site = b3.site", R, ints="site freeze_thaw")
register("b04_episodes_within", lambda g: B.episodes_within(_hourly(g), "T2", ["site"], -2.0, 2.0), f"{HOURLY}, {B4}\n--\nSELECT s.site, CASE WHEN k >= 2 THEN k END AS episodes, l AS episode_length FROM (SELECT DISTINCT site FROM hourly) s LEFT JOIN b4 ON s.site = b4.site", R, ints="site episodes", vals="episode_length")
register("b05_diurnal_amplitude", lambda g: B.diurnal_amplitude(_hourly(g), "T3", ["site"]), HOURLY + "\n--\nSELECT site, avg(a) AS diurnal_amplitude FROM (SELECT site, max(T3) - min(T3) AS a FROM hourly GROUP BY site, date_trunc('day', time)) GROUP BY 1", R, ints="site", vals="diurnal_amplitude")
WARM = "SELECT site, sum(CASE WHEN t > 0 THEN t ELSE 0 END) AS summer_warmth, -sum(CASE WHEN t < 0 THEN t ELSE 0 END) AS winter_coldness FROM (SELECT site, avg(T3) AS t FROM skill GROUP BY site, date_trunc('month', time)) GROUP BY 1"
register("b06_summer_warmth", lambda g: B.warmth_and_coldness(g("skill"), "T3", ["site"]), WARM, ["skill"], ints="site", vals="summer_warmth")
register("b07_winter_coldness", lambda g: B.warmth_and_coldness(g("skill"), "T3", ["site"]), WARM, ["skill"], ints="site", vals="winter_coldness")
register("b08_mean_temp", lambda g: B.indicators(_hourly(g), "T2", ["site"]).select("site", "mean_temp"), HOURLY + "\n--\nSELECT site, avg(T2) AS mean_temp FROM hourly GROUP BY 1", R, ints="site", vals="mean_temp")
_long = "long AS (SELECT site, region, year(time) AS year, time, s AS series, v FROM (SELECT site, region, time, 'T3' AS s, T3 AS v FROM skill UNION ALL SELECT site, region, time, 'physical_T3', physical_T3 FROM skill))"
register(
    "b09_bioclim_summary", lambda g: B.bioclim_summary(g("skill"), "T3", ["physical_T3"]),
    f"""{_long}, m AS (SELECT region, site, year, series, avg(v) AS mean_temp, sum(CASE WHEN v <= 0 THEN 1 ELSE 0 END) AS frost_hours, sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS degree_hours FROM long GROUP BY 1, 2, 3, 4),
f AS (SELECT region, site, year, series, count(*) AS n, sum(CASE WHEN f <> p THEN 1 ELSE 0 END) AS c FROM (SELECT *, v <= 0 AS f, lag(v <= 0) OVER (PARTITION BY region, site, year, series ORDER BY time) AS p FROM long WHERE v IS NOT NULL) GROUP BY 1, 2, 3, 4),
w AS (SELECT region, site, year, series, sum(CASE WHEN t > 0 THEN t ELSE 0 END) AS summer_warmth FROM (SELECT region, site, year, series, avg(v) AS t FROM long GROUP BY region, site, year, series, date_trunc('month', time)) GROUP BY 1, 2, 3, 4),
a AS (SELECT m.*, CASE WHEN n >= 2 THEN c END AS freeze_thaw, summer_warmth FROM m LEFT JOIN f USING (region, site, year, series) LEFT JOIN w USING (region, site, year, series))
--
SELECT a.region, a.site, a.year, a.series, a.frost_hours, a.freeze_thaw, a.mean_temp, a.degree_hours, a.summer_warmth, CASE WHEN a.series <> 'T3' THEN a.mean_temp - o.mean_temp END AS mean_temp_bias, CASE WHEN a.series <> 'T3' THEN a.frost_hours - o.frost_hours END AS frost_hours_bias
FROM a JOIN a o ON a.region = o.region AND a.site = o.site AND a.year = o.year AND o.series = 'T3'""",
    ["skill"], keys="region series", ints="site year frost_hours freeze_thaw", vals="mean_temp degree_hours summer_warmth mean_temp_bias frost_hours_bias",
)
register(
    "b10_calendar_columns", lambda g: timecols.calendar_columns(g("skill")).withColumn("date", F.col("date").cast("timestamp")),
    "SELECT site, time, year(time) AS year, month(time) AS month, dayofyear(time) AS doy, hour(time) AS hour, date_trunc('day', time) AS date, year(time) + CASE WHEN month(time) >= 9 THEN 1 ELSE 0 END AS hydro_year FROM skill", ["skill"], times="time date", ints="site year month doy hour hydro_year",
)
register("b11_day_of_year_365", lambda g: g("skill").select("site", "time", timecols.day_of_year("time").alias("doy")), f"SELECT site, time, {DOY.replace('date', 'time')} AS doy FROM skill", ["skill"], times="time", ints="site doy")
register(
    "b12_lag_features", lambda g: S.lag_features(g("reanalysis"), ["t2m"], ["lat", "lon"]),
    'SELECT time, lat, lon, lead(t2m, 3) OVER w AS "t2m_+003", t2m AS "t2m_+000", lag(t2m, 3) OVER w AS "t2m_-003", lag(t2m, 6) OVER w AS "t2m_-006" FROM reanalysis WINDOW w AS (PARTITION BY lat, lon ORDER BY time)', ["reanalysis"], times="time", vals="lat lon t2m_+003 t2m_+000 t2m_-003 t2m_-006",
)
register(
    "b13_fill_gaps", lambda g: S.fill_gaps(g("readings"), ["T2"], ["site"], ["time", "row_id"]),
    "SELECT row_id, coalesce(last_value(T2 IGNORE NULLS) OVER (PARTITION BY site ORDER BY time, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(T2 IGNORE NULLS) OVER (PARTITION BY site ORDER BY time, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS T2 FROM readings", R, ints="row_id", vals="T2",
)
register(
    "b14_detrend", lambda g: S.detrend(g("skill"), "T3", ["site"]),
    "l AS (SELECT site, regr_slope(T3, epoch(time) / 86400e0) AS slope, regr_intercept(T3, epoch(time) / 86400e0) AS intercept FROM skill GROUP BY 1)\n--\nSELECT k.site, time, slope, T3 - (intercept + slope * epoch(time) / 86400e0) AS residual FROM skill k JOIN l ON k.site = l.site", ["skill"], times="time", ints="site", vals="slope residual", digits=4,
)
register(
    "b15_cyclical_features", lambda g: timecols.cyclical_features(g("readings")),
    """SELECT row_id, year(time) AS Cycle_years, sin(2 * pi() * dayofyear(time) / 366e0) AS Cycle_ann_sin, cos(2 * pi() * dayofyear(time) / 366e0) AS Cycle_ann_cos, sin(2 * pi() * day(last_day(time)) / 31e0) AS Cycle_mon_sin,
cos(2 * pi() * (isodow(time) - 1) / 7e0) AS Cycle_wee_cos, sin(2 * pi() * hour(time) / 24e0) AS Cycle_diu_sin FROM readings""", R, ints="row_id Cycle_years", vals="Cycle_ann_sin Cycle_ann_cos Cycle_mon_sin Cycle_wee_cos Cycle_diu_sin",
)
register(
    "b16_gaussian_smooth_1d", lambda g: S.gaussian_smooth_1d(A.daily_climatology(g("skill"), ["T3"]), "T3_mean", ["region"], "doy", 5.0),
    DAILY + f""", clim AS (SELECT region, {DOY} AS doy, avg(T3_mean) AS v FROM daily WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY 1, 2), c AS (SELECT region, doy, v, row_number() OVER (PARTITION BY region ORDER BY doy) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM clim)
--
SELECT a.region, a.doy, sum(exp(-0.5e0 * power(k / 5e0, 2)) * b.v) / sum(exp(-0.5e0 * power(k / 5e0, 2))) AS T3_mean_smooth FROM c a CROSS JOIN (SELECT unnest(range(-20, 21)) AS k) JOIN c b ON a.region = b.region AND b.i = (a.i + k + 20 * a.n) % a.n GROUP BY 1, 2""",
    ["skill"], keys="region", ints="doy", vals="T3_mean_smooth",
)
register(
    "b17_temperature_offsets", lambda g: S.add_base(S.temperature_offsets(g("skill"), ["T3"], "coarse_T3", kelvin=False).drop("T3"), ["T3_offset"], "coarse_T3", kelvin=False),
    "SELECT site, time, T3 - coarse_T3 AS T3_offset, T3 FROM skill", ["skill"], times="time", ints="site", vals="T3_offset T3",
)
# ---- set operations
register("o03_union_of_frames", lambda g: g("sites").filter("x < 3000").unionByName(g("sites").filter("region in ('ASIA', 'AFRICA')")), "SELECT site, region FROM sites WHERE x < 3000 UNION ALL SELECT site, region FROM sites WHERE region IN ('ASIA', 'AFRICA')", ["sites"], keys="region", ints="site")
register("o04_intersect_times", lambda g: g("reanalysis").select("time").intersect(g("skill").select("time")), "SELECT time FROM reanalysis INTERSECT SELECT time FROM skill", ["reanalysis", "skill"], times="time")
register("o05_distinct_sites", lambda g: g("readings").select("site").dropDuplicates(), "SELECT DISTINCT site FROM readings", R, ints="site")
register("o01_ordered_rows", lambda g: g("skill").orderBy("region", "site", "time").withColumn("k", F.lit(1)).groupBy("region").agg(F.max_by("site", F.struct("time", "site")).alias("last_site")), "SELECT region, site AS last_site FROM (SELECT region, site, row_number() OVER (PARTITION BY region ORDER BY time DESC, site DESC) AS k FROM skill) WHERE k = 1", ["skill"], keys="region", ints="last_site")
register("o02_rank_top_k", lambda g: g("skill").groupBy("site").agg(F.avg("T3").alias("T3")).orderBy(F.desc("T3"), "site").limit(7), "SELECT site, avg(T3) AS T3 FROM skill GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7", ["skill"], ints="site", vals="T3")
register("o07_set_difference", lambda g: g("sites").select("region").distinct().exceptAll(g("sites").filter("region = 'ASIA'").select("region").distinct()), "SELECT DISTINCT region FROM sites WHERE region <> 'ASIA'", ["sites"], keys="region")

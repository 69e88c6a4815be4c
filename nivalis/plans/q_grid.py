"""Queries over grids: interpolation, terrain, physics, dense prediction, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nivalis.functions import physics as D
from nivalis.operators import aggregate as A
from nivalis.operators import interpolate as I
from nivalis.operators import select as P
from nivalis.operators import terrain as T
from nivalis.plans import dense as DP
from nivalis.plans import modelling as L
from nivalis.plans.registry import register
from nivalis.sources import io
from nivalis.streaming import readings as live
from nivalis.tables import shared_folder

DEM, REA = ["dem"], ["reanalysis"]

# ---- interpolation
AX = "ax AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS b0, max(lon) AS b1 FROM reanalysis)"
register(
    "i01_nearest_cell", lambda g: I.nearest_cell(g("sites"), g("reanalysis")),
    f"{AX}\n--\nSELECT site, a0 + 2 * least(greatest(ceil((lat - a0) / 2 - 0.5e0), 0), 4) AS cell_lat, b0 + 2 * least(greatest(ceil((lon - b0) / 2 - 0.5e0), 0), 4) AS cell_lon FROM sites, ax", ["sites", "reanalysis"], ints="site", vals="cell_lat cell_lon",
)
# the same cells on axes whose steps grow: squares of the coordinates
_squared = lambda df, *cols: df.withColumns({c: F.col(c) * F.col(c) for c in cols})
UNEVEN = """la AS (SELECT lat * lat AS a, row_number() OVER (ORDER BY lat) - 1 AS k FROM (SELECT DISTINCT lat FROM reanalysis)), lo AS (SELECT lon * lon AS b, row_number() OVER (ORDER BY lon) - 1 AS k FROM (SELECT DISTINCT lon FROM reanalysis)),
s2 AS (SELECT site, lat * lat AS a, lon * lon AS b FROM sites)"""
register(
    "i01_nearest_uneven", lambda g: I.nearest_cell(_squared(g("sites"), "lat", "lon"), _squared(g("reanalysis"), "lat", "lon")),
    f"{UNEVEN}\n--\nSELECT site, (SELECT arg_min(la.a, (abs(la.a - s2.a), la.a)) FROM la) AS cell_lat, (SELECT arg_min(lo.b, (abs(lo.b - s2.b), lo.b)) FROM lo) AS cell_lon FROM s2", ["sites", "reanalysis"], ints="site", vals="cell_lat cell_lon",
)
register(
    "i02_bilinear_uneven", lambda g: I.interp_bilinear(_squared(g("sites"), "lat", "lon"), _squared(g("reanalysis").groupBy("lat", "lon").agg(F.avg("t2m").alias("t2m")), "lat", "lon"), "t2m", cols=("lat", "lon")),
    f"""{UNEVEN}, m AS (SELECT lat * lat AS a, lon * lon AS b, avg(t2m) AS v FROM reanalysis GROUP BY 1, 2),
e AS (SELECT site, x.a AS a0, y.a AS a1, u.b AS b0, v.b AS b1, (s2.a - x.a) / (y.a - x.a) AS p, (s2.b - u.b) / (v.b - u.b) AS q FROM s2 JOIN la x ON s2.a >= x.a JOIN la y ON y.k = x.k + 1 AND s2.a < y.a JOIN lo u ON s2.b >= u.b JOIN lo v ON v.k = u.k + 1 AND s2.b < v.b),
i AS (SELECT site, (1 - p) * (1 - q) * m00.v + (1 - p) * q * m01.v + p * (1 - q) * m10.v + p * q * m11.v AS t2m FROM e JOIN m m00 ON m00.a = a0 AND m00.b = b0 JOIN m m01 ON m01.a = a0 AND m01.b = b1 JOIN m m10 ON m10.a = a1 AND m10.b = b0 JOIN m m11 ON m11.a = a1 AND m11.b = b1)
--
SELECT site, i.t2m FROM s2 LEFT JOIN i USING (site)""", ["sites", "reanalysis"], ints="site", vals="t2m",
)
_points = lambda g: g("dem").select("region", F.concat_ws("_", "iy", "ix").alias("site"), (F.col("x") + 3.7).alias("x"), (F.col("y") - 4.2).alias("y"))
register(
    "i02_interp_bilinear", lambda g: I.interp_bilinear(_points(g), g("dem"), ["dem10m", "svf"], ["region"], ["region", "site"]),
    """p AS (SELECT region, concat(iy, '_', ix) AS site, iy, ix FROM dem),
ax AS (SELECT region AS r, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny FROM dem GROUP BY 1),
c AS (SELECT p.region, site, (CASE WHEN i = 1 THEN 0.37e0 ELSE 0.63e0 END) * (CASE WHEN j = 1 THEN 0.42e0 ELSE 0.58e0 END) AS w, d.dem10m, d.svf FROM p JOIN ax ON p.region = r CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j) LEFT JOIN dem d ON d.region = p.region AND d.ix = p.ix + i AND d.iy = p.iy + j WHERE nx > 1 AND ny > 1 AND p.ix < 49 AND p.iy < 19)
--
SELECT p.region, p.site, CASE WHEN count(dem10m) = 4 THEN sum(w * dem10m) END AS dem10m, CASE WHEN count(svf) = 4 THEN sum(w * svf) END AS svf FROM p LEFT JOIN c ON p.region = c.region AND p.site = c.site GROUP BY 1, 2""", DEM, keys="region site", vals="dem10m svf",
)
TRI = """q AS (SELECT DISTINCT site, time, lat, lon FROM skill), ts AS (SELECT DISTINCT time AS t FROM reanalysis),
b AS (SELECT q.site, q.time, lat, lon, (SELECT max(t) FROM ts WHERE t <= q.time) AS t0, (SELECT min(t) FROM ts WHERE t >= q.time) AS t1 FROM q),
e AS (SELECT site, time, lat, lon, t0 AS t, CASE WHEN t0 = t1 THEN 1 ELSE 1 - (epoch(time) - epoch(t0)) / (epoch(t1) - epoch(t0)) END AS s FROM b WHERE t0 IS NOT NULL AND t1 IS NOT NULL UNION ALL SELECT site, time, lat, lon, t1, (epoch(time) - epoch(t0)) / (epoch(t1) - epoch(t0)) FROM b WHERE t0 < t1),
f AS (SELECT *, least(floor((lat - 65) / 2), 3) AS la, least(floor((lon - 20) / 2), 3) AS lo FROM e WHERE lat BETWEEN 65 AND 73 AND lon BETWEEN 20 AND 28 AND s > 0),
k AS (SELECT site, time, t, 65 + 2 * (la + i) AS kla, 20 + 2 * (lo + j) AS klo, s * (CASE WHEN i = 1 THEN (lat - 65) / 2 - la ELSE 1 - ((lat - 65) / 2 - la) END) * (CASE WHEN j = 1 THEN (lon - 20) / 2 - lo ELSE 1 - ((lon - 20) / 2 - lo) END) AS w FROM f CROSS JOIN (VALUES (0), (1)) x(i) CROSS JOIN (VALUES (0), (1)) y(j)),
v AS (SELECT site, k.time, CASE WHEN count(skt) = count(*) THEN sum(w * skt) END AS skt FROM k LEFT JOIN reanalysis r ON r.time = t AND r.lat = kla AND r.lon = klo WHERE w > 1e-9 GROUP BY 1, 2)
--
SELECT q.site, q.time, skt FROM q LEFT JOIN v ON q.site = v.site AND q.time = v.time"""
register("i03_interp_trilinear", lambda g: I.interp_trilinear(g("skill").select("site", "time", "lat", "lon").distinct(), g("reanalysis"), ["skt"]), TRI, ["skill", "reanalysis"], times="time", ints="site", vals="skt")
MEANS = "m AS (SELECT lat, lon, avg(skt) AS skt FROM reanalysis GROUP BY 1, 2)"
register(
    "i04_regrid", lambda g: I.regrid(g("reanalysis").groupBy("lat", "lon").agg(F.avg("skt").alias("skt")), [65.0, 66.5, 70.2, 73.0], [20.0, 23.4, 27.9], ["skt"]),
    f"{MEANS}\n--\nSELECT a AS lat, b AS lon, skt FROM (VALUES (65e0, 65e0), (66.5e0, 67e0), (70.2e0, 71e0), (73e0, 73e0)) x(a, na) CROSS JOIN (VALUES (20e0, 20e0), (23.4e0, 24e0), (27.9e0, 28e0)) y(b, nb) LEFT JOIN m ON lat = na AND lon = nb", REA, vals="lat lon skt",
)
# the layer: means of two by two cells, on the coordinates of their even rows and columns
_coarse = lambda g: g("dem").groupBy("region", F.floor(F.col("iy") / 2).alias("by"), F.floor(F.col("ix") / 2).alias("bx")).agg(F.avg("svf").alias("svf")).select("region", (F.col("bx") * 20.0).alias("x"), (F.col("by") * -20.0).alias("y"), "svf")
register(
    "i05_align_to_template", lambda g: I.align_to_template(_coarse(g), g("dem"), ["svf"]),
    """c AS (SELECT region, CAST(floor(iy / 2e0) AS INT) AS by_, CAST(floor(ix / 2e0) AS INT) AS bx, avg(svf) AS svf FROM dem GROUP BY 1, 2, 3),
n AS (SELECT region, max(bx) AS mx, max(by_) AS my FROM c GROUP BY 1)
--
SELECT a.region, a.x, a.y, c.svf FROM dem a JOIN n ON a.region = n.region LEFT JOIN c ON c.region = a.region AND mx > 0 AND my > 0 AND c.bx = least(CAST(ceil(a.ix / 2e0 - 0.5e0) AS INT), mx) AND c.by_ = CASE WHEN a.iy % 2 = 0 THEN a.iy / 2 ELSE least((a.iy + 1) / 2, my) END""", DEM, keys="region", vals="x y svf",
)
register(
    "i06_stack_layers", lambda g: I.stack_layers([g("dem").filter("svf > 0.5").select("region", "iy", "ix", "svf"), g("dem").filter("mbi < 1").select("region", "iy", "ix", "mbi")]),
    "SELECT region, iy, ix, CASE WHEN svf > 0.5 THEN svf END AS svf, CASE WHEN mbi < 1 THEN mbi END AS mbi FROM dem WHERE svf > 0.5 OR mbi < 1", DEM, keys="region", ints="iy ix", vals="svf mbi",
)
register(
    "i07_interp_like", lambda g: I.interp_like(g("dem").withColumn("mask", F.col("svf")), g("dem").select("region", F.col("x") + 2.5, F.col("y") - 7.5).toDF("region", "x", "y"), "mask"),
    """ax AS (SELECT region AS r, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny FROM dem GROUP BY 1),
c AS (SELECT p.region, p.ix, p.iy, (CASE WHEN i = 1 THEN 0.25e0 ELSE 0.75e0 END) * (CASE WHEN j = 1 THEN 0.75e0 ELSE 0.25e0 END) AS w, d.svf FROM dem p JOIN ax ON p.region = r CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j) LEFT JOIN dem d ON d.region = p.region AND d.ix = p.ix + i AND d.iy = p.iy + j WHERE nx > 1 AND ny > 1 AND p.ix < 49 AND p.iy < 19),
v AS (SELECT region, ix, iy, CASE WHEN count(svf) = 4 THEN sum(w * svf) END AS mask FROM c GROUP BY 1, 2, 3)
--
SELECT p.region, p.x + 2.5e0 AS x, p.y - 7.5e0 AS y, v.mask FROM dem p LEFT JOIN v ON p.region = v.region AND p.ix = v.ix AND p.iy = v.iy""", DEM, keys="region", vals="x y mask",
)
# each region's grid is the model field of a day of January 1995, cells are the sites
_day = lambda: F.timestamp_seconds(F.lit(788918400) + F.regexp_extract("region", "[0-9]+", 0).cast("int") * 86400)
register(
    "s08_model_output_at_sites", lambda g: io.read_model_output_at_sites(g("dem").select(_day().alias("time"), "x", "y", "dem10m"), g("dem").select((F.col("iy") * 50 + F.col("ix")).alias("site"), (F.col("x") + 2).alias("x"), (F.col("y") - 2).alias("y")).distinct(), g("skill"), "dem10m", "micro_T3"),
    """n AS (SELECT region, max(ix) AS mx, max(iy) AS my FROM dem GROUP BY 1),
s AS (SELECT DISTINCT iy * 50 + ix AS site, iy, ix FROM dem),
c AS (SELECT n.region, s.site, (CASE WHEN i = 1 THEN 0.2e0 ELSE 0.8e0 END) * (CASE WHEN j = 1 THEN 0.2e0 ELSE 0.8e0 END) AS w, d.dem10m FROM s JOIN n ON s.ix < mx AND s.iy < my CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j) LEFT JOIN dem d ON d.region = n.region AND d.ix = s.ix + i AND d.iy = s.iy + j),
v AS (SELECT site, TIMESTAMP '1995-01-01' + to_days(CAST(substr(region, 2) AS INT)) AS at_, CASE WHEN count(dem10m) = 4 THEN sum(w * dem10m) END AS m FROM c GROUP BY 1, 2)
--
SELECT k.time, k.site, T3, v.m AS micro_T3 FROM skill k LEFT JOIN v ON k.site = v.site AND k.time = v.at_""", ["skill", "dem"], times="time", ints="site", vals="T3 micro_T3",
)

# ---- terrain
FULL = """full_ AS (SELECT s.region, s.iy, s.ix, d.dem10m, d.svf, d.mbi, d.norm_height, d.windexp500, s.ix * 10e0 AS x, s.iy * -10e0 AS y
FROM (SELECT region, iy, unnest(range(c, e + 1)) AS ix FROM (SELECT region, c, e, unnest(range(a, b + 1)) AS iy FROM (SELECT region, min(iy) AS a, max(iy) AS b, min(ix) AS c, max(ix) AS e FROM dem GROUP BY 1))) s LEFT JOIN dem d ON d.region = s.region AND d.iy = s.iy AND d.ix = s.ix),
sp AS (SELECT region AS r, min(iy) AS y0, max(iy) AS y1, min(ix) AS x0, max(ix) AS x1, max(ix) - min(ix) + 1 AS nx, max(iy) - min(iy) + 1 AS ny FROM dem GROUP BY 1)"""


def sql_smooth(out: str, source: str, value: str, lo: int, hi: int, weight: str, mode: str, keep_null: bool = False) -> str:
    """CTEs: two passes over one axis each; `weight` is an expression of the offset k."""
    pos = {
        "nearest": lambda c: f"least(greatest(a.i{c} + k, {c}0), {c}1)",
        "wrap": lambda c: f"{c}0 + (a.i{c} - {c}0 + k + 1000 * n{c}) % n{c}",
        "zero": lambda c: f"a.i{c} + k",
    }[mode]
    outside = {"zero": lambda c: f" AND a.i{c} + k BETWEEN {c}0 AND {c}1"}.get(mode, lambda c: "")
    total = (lambda e: f"CASE WHEN count({e}) = count(*) THEN sum(w * {e}) END") if keep_null else (lambda e: f"sum(w * {e})")
    n, d = ("v", "0e0") if keep_null else ("coalesce(v, 0)", "CASE WHEN v IS NULL THEN 0e0 ELSE 1e0 END")
    last = "n" if keep_null else "n / nullif(d, 0)"
    return f"""{out}_k AS (SELECT k, {weight} AS w FROM (SELECT unnest(range({lo}, {hi} + 1)) AS k)),
{out}_s AS (SELECT region, iy, ix, {n} AS n, {d} AS d FROM (SELECT region, iy, ix, {value} AS v FROM {source})),
{out}_x AS (SELECT a.region, a.iy, a.ix, {total('b.n')} AS n, sum(w * b.d) AS d FROM {out}_s a JOIN sp ON a.region = r CROSS JOIN {out}_k JOIN {out}_s b ON b.region = a.region AND b.iy = a.iy AND b.ix = {pos('x')}{outside('x')} GROUP BY 1, 2, 3),
{out} AS (SELECT region, iy, ix, {last} AS m FROM (SELECT a.region, a.iy, a.ix, {total('b.n')} AS n, sum(w * b.d) AS d FROM {out}_x a JOIN sp ON a.region = r CROSS JOIN {out}_k JOIN {out}_x b ON b.region = a.region AND b.ix = a.ix AND b.iy = {pos('y')}{outside('y')} GROUP BY 1, 2, 3))"""


def box(out: str, value: str, win: int, source: str = "full_") -> str:
    return sql_smooth(out, source, value, -(win // 2), win - 1 - win // 2, "1e0", "nearest")


def gauss(out: str, value: str, sigma: int, source: str = "full_") -> str:
    return sql_smooth(out, source, value, -4 * sigma, 4 * sigma, f"exp(-0.5e0 * power(k / {sigma}e0, 2))", "wrap")


_full = lambda g: T.fill_grid(g("dem")).withColumns({"x": F.col("ix") * 10.0, "y": F.col("iy") * -10.0})
Z = lambda v: f"(({v}) - avg({v}) OVER w) / (stddev_pop({v}) OVER w + 1e-12)"
N = lambda v: f"(({v}) - min({v}) OVER w) / (max({v}) OVER w - min({v}) OVER w + 1e-12)"
W = "WINDOW w AS (PARTITION BY region)"
CELL = {"adapters": DEM, "keys": "region", "ints": "iy ix"}

register("t01_zscore", lambda g: T.zscore(g("dem"), "dem10m", "z"), f"SELECT region, iy, ix, {Z('dem10m')} AS z FROM dem {W}", vals="z", **CELL)
register("t02_norm01", lambda g: T.norm01(g("dem"), "dem10m", "n"), f"SELECT region, iy, ix, {N('dem10m')} AS n FROM dem {W}", vals="n", **CELL)
register("t03_box_mean_3", lambda g: T.box_mean(_full(g), ["dem10m"], 3), f"{FULL}, {box('b', 'dem10m', 3)}\n--\nSELECT region, iy, ix, m AS dem10m FROM b", vals="dem10m", **CELL)
register("t03_box_mean_50", lambda g: T.box_mean(_full(g), ["dem10m"], 50), f"{FULL}, {box('b', 'dem10m', 50)}\n--\nSELECT region, iy, ix, m AS dem10m FROM b", vals="dem10m", **CELL)
SLOPE = """g_ AS (SELECT region, iy, ix, CASE WHEN lag(ix) OVER x IS NULL THEN lead(dem10m) OVER x - dem10m WHEN lead(ix) OVER x IS NULL THEN dem10m - lag(dem10m) OVER x ELSE (lead(dem10m) OVER x - lag(dem10m) OVER x) / 2 END AS gx,
CASE WHEN lag(iy) OVER y IS NULL THEN lead(dem10m) OVER y - dem10m WHEN lead(iy) OVER y IS NULL THEN dem10m - lag(dem10m) OVER y ELSE (lead(dem10m) OVER y - lag(dem10m) OVER y) / 2 END AS gy FROM full_ WINDOW x AS (PARTITION BY region, iy ORDER BY ix), y AS (PARTITION BY region, ix ORDER BY iy)),
sl AS (SELECT region, iy, ix, CASE WHEN nx > 1 THEN atan(gx / 10e0) END AS sx, CASE WHEN ny > 1 THEN atan(gy / -10e0) END AS sy FROM g_ JOIN sp ON region = r)"""
register("t04_gradient_slope", lambda g: T.gradient_slope(_full(g)), f"{FULL}, {SLOPE}\n--\nSELECT region, iy, ix, sx AS slope_x, sy AS slope_y FROM sl", vals="slope_x slope_y", **CELL)
BLACK5 = "(0.42e0 - 0.5e0 * cos(2 * pi() * (k + 2) / 4e0) + 0.08e0 * cos(4 * pi() * (k + 2) / 4e0)) / 1.68e0"
register(
    "t05_kernel_smooth", lambda g: T.kernel_smooth(T.gradient_slope(_full(g).fillna(300.0, ["dem10m"])), ["slope_x", "slope_y"], 5),
    f"{FULL.replace('d.dem10m,', 'coalesce(d.dem10m, 300) AS dem10m,')}, {SLOPE}, {sql_smooth('kx', 'sl', 'sx', -2, 2, BLACK5, 'zero', True)}, {sql_smooth('ky', 'sl', 'sy', -2, 2, BLACK5, 'zero', True)}\n--\nSELECT kx.region, kx.iy, kx.ix, kx.m AS slope_x, ky.m AS slope_y FROM kx JOIN ky ON kx.region = ky.region AND kx.iy = ky.iy AND kx.ix = ky.ix", vals="slope_x slope_y", **CELL,
)
ASPECT = "((degrees(atan2(sx, sy)) + 360) - 360 * floor((degrees(atan2(sx, sy)) + 360) / 360))"
register("t06_slope_aspect", lambda g: T.slope_aspect(T.gradient_slope(_full(g))), f"{FULL}, {SLOPE}\n--\nSELECT region, iy, ix, degrees(atan(sqrt(sx * sx + sy * sy))) AS slope_degrees, sin(radians({ASPECT})) AS aspect_sin, cos(radians({ASPECT})) AS aspect_cos FROM sl", vals="slope_degrees aspect_sin aspect_cos", **CELL)
register("t07_top_position_index", lambda g: T.top_position_index(_full(g), 3), f"{FULL}, {gauss('s', 'dem10m', 3)}\n--\nSELECT f.region, f.iy, f.ix, dem10m - m AS tpi FROM full_ f JOIN s ON f.region = s.region AND f.iy = s.iy AND f.ix = s.ix", vals="tpi", **CELL)
# the kernel of three is 0, 1, 0: slopes stay, and nulls spread
T08 = {"slope_degrees": "degrees(atan(sqrt(sx * sx + sy * sy)))", "slope_x_degrees": "degrees(sx)", "slope_y_degrees": "degrees(sy)", "aspect_sin": f"sin(radians({ASPECT}))", "aspect_cos": f"cos(radians({ASPECT}))"}
HOLES = {"slope_x_degrees": "holes_x", "slope_y_degrees": "holes_y"}
register(
    "t08_terrain_features", lambda g: T.terrain_features(_full(g), 3),
    f"{FULL}, {SLOPE}, {gauss('s', 'dem10m', 3)}, n3 AS (SELECT a.region, a.iy, a.ix, sum(CASE WHEN b.sx IS NULL OR b.sy IS NULL THEN 1 ELSE 0 END) AS holes, sum(CASE WHEN b.sx IS NULL THEN 1 ELSE 0 END) AS holes_x, sum(CASE WHEN b.sy IS NULL THEN 1 ELSE 0 END) AS holes_y FROM sl a JOIN sl b ON a.region = b.region AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY 1, 2, 3)\n--\nSELECT f.region, f.iy, f.ix, {', '.join(f'CASE WHEN {HOLES.get(n, "holes")} = 0 THEN {e} END AS {n}_w3' for n, e in T08.items())}, dem10m - m AS top_posn_idx_w3 FROM full_ f JOIN s ON f.region = s.region AND f.iy = s.iy AND f.ix = s.ix JOIN sl ON f.region = sl.region AND f.iy = sl.iy AND f.ix = sl.ix JOIN n3 ON f.region = n3.region AND f.iy = n3.iy AND f.ix = n3.ix".replace(" = 0 THEN", " = 0 AND dem10m IS NOT NULL THEN"), vals=" ".join(f"{n}_w3" for n in T08) + " top_posn_idx_w3", **CELL,
)
register("t09_ruggedness", lambda g: T.ruggedness(_full(g), 3), f"{FULL}, {box('b', 'dem10m', 3)}, t AS (SELECT f.region, f.iy, f.ix, abs(dem10m - m) AS v FROM full_ f JOIN b ON f.region = b.region AND f.iy = b.iy AND f.ix = b.ix), {box('c', 'v', 3, 't')}\n--\nSELECT region, iy, ix, m AS tri_w3 FROM c", vals="tri_w3", **CELL)
_slopes = lambda g: T.slope_aspect(T.gradient_slope(_full(g)))
SA = f"sa AS (SELECT region, iy, ix, atan(sqrt(sx * sx + sy * sy)) AS s, radians({ASPECT}) AS a FROM sl)"
register(
    "t10_vector_ruggedness", lambda g: T.vector_ruggedness(_slopes(g), 3, "slope_degrees", "aspect_degrees"),
    f"{FULL}, {SLOPE}, {SA}, {box('bx', 'sin(s) * cos(a)', 3, 'sa')}, {box('by_', 'sin(s) * sin(a)', 3, 'sa')}, {box('bz', 'cos(s)', 3, 'sa')}\n--\nSELECT bx.region, bx.iy, bx.ix, 1 - sqrt(bx.m * bx.m + by_.m * by_.m + bz.m * bz.m) AS vrm_w3 FROM bx JOIN by_ USING (region, iy, ix) JOIN bz USING (region, iy, ix)", vals="vrm_w3", **CELL,
)
_two = lambda g: _slopes(g).withColumns({f"{f}_w{w}": F.col(f) * (1.0 if w == 3 else 0.5) for f in ("slope_degrees", "aspect_cos", "aspect_sin") for w in (3, 50)} | {"top_posn_idx_w3": F.col("dem10m"), "top_posn_idx_w50": F.col("svf")})
register("t11_multiscale_contrasts", lambda g: T.multiscale_contrasts(_two(g)), f"{FULL}, {SLOPE}\n--\nSELECT f.region, f.iy, f.ix, degrees(atan(sqrt(sx * sx + sy * sy))) / 2 AS slope_diff_w3_w50, CASE WHEN sx IS NOT NULL AND sy IS NOT NULL THEN 0.5e0 END AS aspect_vecdiff_w3_w50, dem10m - svf AS tpi_diff_w3_w50 FROM full_ f JOIN sl USING (region, iy, ix)", vals="slope_diff_w3_w50 aspect_vecdiff_w3_w50 tpi_diff_w3_w50", **CELL)
CAPI = f"c0 AS (SELECT region, iy, ix, dem10m, {N('svf')} AS sn, norm_height, mbi FROM dem {W}), c1 AS (SELECT region, iy, ix, dem10m, ({Z('-norm_height')} + {Z('-mbi')} + {Z('1 - sn')}) / 3 AS c FROM c0 {W}), capi AS (SELECT region, iy, ix, dem10m, {N('c')} AS capi FROM c1 {W})"
register("t12_cold_air_pooling", lambda g: T.cold_air_pooling(g("dem")), f"{CAPI}\n--\nSELECT * FROM capi", vals="capi", **CELL)
register("t13_openness", lambda g: T.openness(_full(g), 3), f"{FULL}, {box('b', 'dem10m', 3)}, r3 AS (SELECT f.region, f.iy, f.ix, svf, abs(dem10m - m) AS v FROM full_ f JOIN b ON f.region = b.region AND f.iy = b.iy AND f.ix = b.ix)\n--\nSELECT region, iy, ix, 0.5e0 * {N('svf')} + 0.5e0 * {N('v')} AS openness_proxy_w3 FROM r3 {W}", vals="openness_proxy_w3", **CELL)
register("t14_cold_bias", lambda g: T.cold_bias(g("dem")), f"{CAPI}, cb AS (SELECT region, iy, ix, {Z('capi')} + 0.5e0 * {Z('dem10m')} AS v FROM capi {W})\n--\nSELECT region, iy, ix, {N('v')} AS cold_bias_potential FROM cb {W}", vals="cold_bias_potential", **CELL)
_pisr = lambda g: g("dem").withColumns({f"pisr_{m}": F.col("svf") * m + F.col("mbi") + 4 for m in range(1, 13)})
_times = lambda g: g("reanalysis").select("time").distinct()
QT = "qt AS (SELECT DISTINCT time FROM reanalysis), sf AS (SELECT region, iy, ix, time, (svf * month(time) + mbi + 4) / (max(svf * month(time) + mbi + 4) OVER (PARTITION BY region, time) + 1e-12) AS solar_factor FROM dem, qt)"
register("t15_solar_factor", lambda g: T.solar_factor(_pisr(g), _times(g)), f"{QT}\n--\nSELECT * FROM sf", ["dem", "reanalysis"], keys="region", times="time", ints="iy ix", vals="solar_factor")
register("t16_wind_on_slope", lambda g: T.wind_on_slope(g("dem").withColumns({"ws": F.col("svf") * 10, "wd": F.col("ix") * 7.0, "as": F.col("iy") * 17.0}), "ws", "wd", "as"), "SELECT region, iy, ix, svf * 10 * cos(radians(ix * 7e0 - iy * 17e0)) AS wind_along_slope, svf * 10 * sin(radians(ix * 7e0 - iy * 17e0)) AS wind_cross_slope FROM dem", vals="wind_along_slope wind_cross_slope", **CELL)
EXPO = f"x0_ AS (SELECT region, iy, ix, svf, CASE WHEN avg(CASE WHEN windexp500 - 10 > 0 THEN 1e0 ELSE 0e0 END) OVER w < 0.5 THEN -(windexp500 - 10) ELSE windexp500 - 10 END AS v FROM dem {W})"
_wind = lambda g: g("dem").withColumn("windexp500", F.col("windexp500") - 10)
register("t17_wind_exposure", lambda g: T.wind_exposure(_wind(g)), f"{EXPO}\n--\nSELECT region, iy, ix, {N('v')} AS wind_shelter_exposure FROM x0_ {W}", vals="wind_shelter_exposure", **CELL)
register("t18_effective_wind", lambda g: T.effective_wind(_wind(g).withColumn("ws", F.col("svf") * 8), "ws"), f"{EXPO}\n--\nSELECT region, iy, ix, svf * 8 * (0.4e0 + 0.6e0 * {N('v')}) AS wind_speed_effective FROM x0_ {W}", vals="wind_speed_effective", **CELL)
_scales = lambda g: _two(g).withColumns({f"aspect_degrees_w{w}": F.col("aspect_degrees") for w in (3, 50)})
STATIC = [f"{f}_w{w}" for w in (3, 50) for f in ("tri", "vrm", "openness_proxy")]


def _sql_static() -> str:
    """All columns of the static predictors."""
    ctes, last = [FULL, SLOPE, SA], []
    for w in (3, 50):
        half = "" if w == 3 else "0.5e0 * "
        sb = f"sb{w} AS (SELECT region, iy, ix, {half}s AS s, a FROM sa)"
        ctes += [sb, box(f"b{w}", "dem10m", w), f"d{w} AS (SELECT f.region, f.iy, f.ix, f.svf, abs(dem10m - m) AS v FROM full_ f JOIN b{w} b ON f.region = b.region AND f.iy = b.iy AND f.ix = b.ix)"]
        ctes += [box(f"c{w}", "v", w, f"d{w}"), f"o{w} AS (SELECT region, iy, ix, 0.5e0 * {N('svf')} + 0.5e0 * {N('v')} AS o FROM d{w} {W})"]
        ctes += [box(f"{n}{w}", e, w, f"sb{w}") for n, e in (("nx", "sin(s) * cos(a)"), ("ny", "sin(s) * sin(a)"), ("nz", "cos(s)"))]
        last.append(f"c{w}.m AS tri_w{w}, 1 - sqrt(nx{w}.m * nx{w}.m + ny{w}.m * ny{w}.m + nz{w}.m * nz{w}.m) AS vrm_w{w}, o{w}.o AS openness_proxy_w{w}")
    ctes += [CAPI.replace("FROM dem", "FROM full_"), f"cb AS (SELECT region, iy, ix, capi, {Z('capi')} + 0.5e0 * {Z('dem10m')} AS v FROM capi {W}), cn AS (SELECT region, iy, ix, capi, {N('v')} AS cold FROM cb {W})"]
    joins = " ".join(f"JOIN {n}{w} USING (region, iy, ix)" for w in (3, 50) for n in ("c", "o", "nx", "ny", "nz"))
    contrasts = "degrees(sl.s) / 2 AS slope_diff_w3_w50, CASE WHEN sl.a IS NOT NULL THEN 0.5e0 END AS aspect_vecdiff_w3_w50, f.dem10m - f.svf AS tpi_diff_w3_w50"
    return f"{', '.join(ctes)}\n--\nSELECT region, iy, ix, {', '.join(last)}, {contrasts}, cn.capi, cold AS cold_bias_potential FROM full_ f {joins} JOIN cn USING (region, iy, ix) JOIN sa sl USING (region, iy, ix)"


register("t19_static_predictors", lambda g: T.static_predictors(_scales(g), (3, 50)), _sql_static(), vals=" ".join([*STATIC, "slope_diff_w3_w50", "aspect_vecdiff_w3_w50", "tpi_diff_w3_w50", "capi", "cold_bias_potential"]), **CELL)
register(
    "t20_hourly_predictors", lambda g: T.hourly_predictors(_pisr(g).withColumn("as", F.col("iy") * 17.0), _times(g).crossJoin(g("dem").select("region").distinct()).withColumns({"sw": F.month("time") * 10.0, "ws": F.month("time") * 1.5, "wd": F.month("time") * 20.0}), "sw", "ws", "wd", "as"),
    f"{QT}, {EXPO.replace(' - 10', '')}, ex AS (SELECT region, iy, ix, {N('v')} AS e FROM x0_ {W})\n--\nSELECT sf.region, sf.iy, sf.ix, sf.time, month(time) * 10 * solar_factor AS swdown_effective, month(time) * 1.5e0 * (0.4e0 + 0.6e0 * e) AS wind_speed_effective, month(time) * 1.5e0 * cos(radians(month(time) * 20e0 - sf.iy * 17e0)) AS wind_along_slope, month(time) * 1.5e0 * sin(radians(month(time) * 20e0 - sf.iy * 17e0)) AS wind_cross_slope FROM sf JOIN ex USING (region, iy, ix)", ["dem", "reanalysis"], keys="region", times="time", ints="iy ix", vals="swdown_effective wind_speed_effective wind_along_slope wind_cross_slope",
)
register("t21_gaussian_smooth_2d", lambda g: T.gaussian_smooth_2d(_full(g), "dem10m", 5.0), f"{FULL}, {gauss('s', 'dem10m', 5)}\n--\nSELECT region, iy, ix, m AS smooth FROM s", vals="smooth", **CELL)

# ---- physics
ES = lambda t: f"6.112e0 * exp(17.67e0 * ({t}) / (({t}) + 243.5e0))"
TC, TD = "t2m - 273.15e0", "d2m - 273.15e0"
RKEY = {"adapters": REA, "times": "time"}
register("d01_relative_humidity", lambda g: g("reanalysis").select("time", "lat", "lon", D.relative_humidity(D.kelvin_to_celsius("t2m"), D.kelvin_to_celsius("d2m")).alias("rh"), D.relative_humidity_rule("t2m", "d2m").alias("rule")), f"SELECT time, lat, lon, 100 * ({ES(TD)}) / ({ES(TC)}) AS rh, 100 - 5 * (t2m - d2m) AS rule FROM reanalysis", vals="lat lon rh rule", **RKEY)
register("d02_specific_humidity", lambda g: g("reanalysis").select("time", "lat", "lon", (D.specific_humidity(F.lit(1000.0), D.kelvin_to_celsius("d2m")) * 1000).alias("q1"), (D.specific_humidity_mixed(F.lit(1000.0), D.kelvin_to_celsius("d2m")) * 1000).alias("q2")), f"e AS (SELECT time, lat, lon, {ES(TD)} AS e FROM reanalysis)\n--\nSELECT time, lat, lon, 1000 * 0.622e0 * e / (1000 - 0.378e0 * e) AS q1, 1000 * 0.622e0 * (e / (1000 - e)) * (622e0 * e / (1000 - e) / 100) AS q2 FROM e", vals="lat lon q1 q2", **RKEY)
register("d03_reanalysis_derived", lambda g: D.reanalysis_derived(g("reanalysis")), f"SELECT time, lat, lon, skt, 100 * ({ES(TD)}) / ({ES(TC)}) AS rh, ssrd - fdir AS difr FROM reanalysis", vals="lat lon skt rh difr", digits=3, **RKEY)
TILT = "radians(-23.45e0 * cos(2 * pi() / 365 * (dayofyear(time) + 10)))"
register("d04_solar_zenith", lambda g: g("readings").join(g("sites"), "site").select("row_id", D.solar_zenith("lat", "time", F.hour("time")).alias("zenith")), f"SELECT row_id, degrees(acos(sin(radians(lat)) * sin({TILT}) + cos(radians(lat)) * cos({TILT}) * cos(radians(15e0 * (hour(time) - 12))))) AS zenith FROM readings r JOIN sites s ON r.site = s.site", ["readings", "sites"], ints="row_id", vals="zenith")
NN = 1 / 298.257222101 / (2 - 1 / 298.257222101)
AA = 6378137.0 / (1 + NN) * (1 + NN**2 / 4 + NN**4 / 64) * 0.9996
BETA = (NN / 2 - 2 * NN**2 / 3 + 37 * NN**3 / 96, NN**2 / 48 + NN**3 / 15, 17 * NN**3 / 480)
DELTA = (2 * NN - 2 * NN**2 / 3 - 2 * NN**3, 7 * NN**2 / 3 - 8 * NN**3 / 5, 56 * NN**3 / 15)
COSH, SINH = (lambda v: f"((exp({v}) + exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) - exp(-({v}))) / 2)")
register(
    "d05_project_tm35fin", lambda g: D.project_tm35fin(g("sites").select("site", (F.col("x") * 40 + 300000).alias("x"), (F.col("y") * 2 + 7400000).alias("y"))),
    f"u AS (SELECT site, (y * 2 + 7400000) / {AA!r}::DOUBLE AS xi, (x * 40 + 300000 - 500000) / {AA!r}::DOUBLE AS eta FROM sites), v AS (SELECT site, xi - "
    + " - ".join(f"{b!r}::DOUBLE * sin({2 * j} * xi) * {COSH(f'{2 * j} * eta')}" for j, b in enumerate(BETA, 1)) + " AS p, eta - "
    + " - ".join(f"{b!r}::DOUBLE * cos({2 * j} * xi) * {SINH(f'{2 * j} * eta')}" for j, b in enumerate(BETA, 1)) + f" AS q FROM u), c AS (SELECT site, p, q, asin(sin(p) / {COSH('q')}) AS chi FROM v)\n--\n"
    + f"SELECT site, 27 + degrees(atan2({SINH('q')}, cos(p))) AS lon, degrees(chi + " + " + ".join(f"{d!r}::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(DELTA, 1)) + ") AS lat FROM c",
    ["sites"], ints="site", vals="lon lat", digits=7,
)
register("d06_kelvin_to_celsius", lambda g: g("reanalysis").select("time", "lat", "lon", D.kelvin_to_celsius("t2m").alias("t2m")), "SELECT time, lat, lon, t2m - 273.15e0 AS t2m FROM reanalysis", vals="lat lon t2m", **RKEY)


# ---- dense prediction and streams
def _predict_grid(g):
    cube, points = g("reanalysis"), g("dem").filter("ix between 5 and 40 and iy between 3 and 15").select("region", "x", "y")
    grid = g("dem").withColumns({"lat": 66.0 + F.col("iy") / 10.0, "lon": 21.0 + F.col("ix") / 10.0})
    train = cube.withColumns({"skt_offset": F.col("t2m") - F.col("skt"), "dem10m": F.col("lat") * 3, "skt_+000": F.col("skt")})
    model = L.boosted_offsets(train, ["skt_+000", "dem10m"], ["skt_offset"], maxIter=3, maxDepth=3)
    return L.predict_grid(model, grid.drop("region_id"), cube, points, 1996, 3, ["dem10m", "svf"], ["skt"], 400, 0.0, "skt_+000")


class _Known:
    """Predicts a function that SQL knows as well."""

    def transform(self, df):
        return df.withColumn("predicted_skt_offset", F.col("skt_+000") * 0.1 + F.col("dem10m"))


def _predict_months(g):
    """Every region in every month, written in tiles and read again."""
    cube = g("reanalysis")
    grid = g("dem").withColumns({"lat": 66.0 + F.col("iy") / 10.0, "lon": 21.0 + F.col("ix") / 10.0}).drop("region_id")
    months = cube.select(F.year("time").alias("year"), F.month("time").alias("month")).distinct().crossJoin(g("dem").select("region").distinct())
    made = DP.predict_months(_Known(), grid, cube, g("dem").select("region", "x", "y"), months, ["dem10m", "svf"], ["skt"], 130, 0.0, "skt_+000")
    spark = made.sparkSession
    path = f"{shared_folder(spark)}/dense-{uuid.uuid4().hex}"
    tiled = made.withColumns({"year": F.year("time"), "month": F.month("time")})
    DP.write_tiles(tiled, path, ["year", "month"], within=["region"])  # regions are many and small
    return spark.read.schema(tiled.schema).parquet(path)


MONTHS = """sp AS (SELECT region AS r, min(iy) AS y0, max(iy) - min(iy) + 1 AS ny, min(ix) AS x0, max(ix) - min(ix) + 1 AS nx FROM dem WHERE dem10m IS NOT NULL AND svf IS NOT NULL GROUP BY 1),
st AS (SELECT r, y0, x0, min(k) AS k FROM sp, (SELECT unnest(range(1, 60)) AS k) WHERE ceil(ny / k) * ceil(nx / k) <= 130 GROUP BY 1, 2, 3),
c AS (SELECT region, iy, ix, dem10m, 66e0 + iy / 10e0 AS lat, 21e0 + ix / 10e0 AS lon FROM dem JOIN st ON region = r WHERE dem10m IS NOT NULL AND svf IS NOT NULL AND (iy - y0) % k = 0 AND (ix - x0) % k = 0),
ts AS (SELECT DISTINCT time FROM reanalysis),
f AS (SELECT c.*, time, least(floor((lat - 65) / 2), 3) AS la, least(floor((lon - 20) / 2), 3) AS lo FROM c, ts),
k AS (SELECT f.*, 65 + 2 * (la + i) AS kla, 20 + 2 * (lo + j) AS klo, (CASE WHEN i = 1 THEN (lat - 65) / 2 - la ELSE 1 - ((lat - 65) / 2 - la) END) * (CASE WHEN j = 1 THEN (lon - 20) / 2 - lo ELSE 1 - ((lon - 20) / 2 - lo) END) AS w FROM f CROSS JOIN (VALUES (0), (1)) x(i) CROSS JOIN (VALUES (0), (1)) y(j)),
v AS (SELECT region, iy, ix, k.time, any_value(dem10m) AS dem10m, CASE WHEN count(skt) = count(*) THEN sum(w * skt) END AS skt FROM k LEFT JOIN reanalysis r ON r.time = k.time AND r.lat = kla AND r.lon = klo WHERE w > 1e-9 GROUP BY 1, 2, 3, 4)"""
register(
    "l07_predict_months", _predict_months, f"{MONTHS}\n--\nSELECT region, iy, ix, time, skt * 0.1e0 + dem10m AS predicted_skt_offset, skt * 0.1e0 + dem10m + skt - 273.15e0 AS predicted_skt FROM v",
    ["dem", "reanalysis"], keys="region", times="time", ints="iy ix", vals="predicted_skt_offset predicted_skt",
)
register("l07_predict_grid", _predict_grid, None, ["dem"], keys="region", times="time", ints="iy ix", vals="predicted_skt_offset predicted_skt")


def _streamed(g, build, schema_of):
    """Run a stream over a table's file to its end and read what it put out."""
    rows = g("readings").select("site", "time", "T1", "T2", "T3", "error_tomst", "row_id")
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    query = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema_of(stream).schema).parquet(f"{folder}/out")


register("st1_stream_hourly_readings", lambda g: _streamed(g, live.stream_hourly_readings, live.stream_hourly_readings), """w AS (SELECT max(time) - INTERVAL 2 HOUR AS mark FROM readings)
--
SELECT site, date_trunc('hour', time) AS time, median(T1) AS T1, median(T2) AS T2, median(T3) AS T3 FROM readings, w WHERE date_trunc('hour', time) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2""", ["readings"], times="time", ints="site", vals="T1 T2 T3")
register("st2_stream_enrich", lambda g: _streamed(g, lambda s: live.stream_enrich(s, g("sites")), lambda s: live.stream_enrich(s, g("sites"))), "SELECT row_id, T3, s.x, s.lat FROM readings r LEFT JOIN sites s ON r.site = s.site WHERE error_tomst = 0", ["readings", "sites"], ints="row_id", vals="T3 x lat")
register("w01_write_table", lambda g: _written(g), "SELECT region, site, time, T3 FROM skill", ["skill"], keys="region", times="time", ints="site", vals="T3")


def _written(g):
    df = A.hourly_median(P.drop_incomplete(g("skill"), ["T3"]), ["T3"], ["region", "site"]).withColumns({"year": F.year("time"), "month": F.month("time")})
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    io.write_table(df, path, ["region", "year", "month"])
    return spark.read.schema(df.schema).parquet(path)

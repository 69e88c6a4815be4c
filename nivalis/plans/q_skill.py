"""Queries over the evaluation table: skill metrics, error summaries, pair statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nivalis.functions import physics as D
from nivalis.functions import skill as M
from nivalis.operators import aggregate as A
from nivalis.operators import pairs as V
from nivalis.operators import select as P
from nivalis.operators.ranges import with_piece
from nivalis.plans import attribution as B
from nivalis.plans import folds as S
from nivalis.plans import modelling as L
from nivalis.plans import regimes as G
from nivalis.plans import tuning as U
from nivalis.plans.registry import register
from nivalis.tables import settle, shared_folder

K = ["skill"]
MODELS = ["gbt_T3", "lasso_T3", "physical_T3", "coarse_T3"]
LONG = "long AS (" + " UNION ALL ".join(f"SELECT region, site, time, T3 AS o, '{m}' AS model, {m} AS m FROM skill" for m in MODELS) + ")"


def sql_pearson(o: str, m: str) -> str:
    o, m = f"CASE WHEN {m} IS NOT NULL THEN {o} END", f"CASE WHEN {o} IS NOT NULL THEN {m} END"
    return f"(covar_pop({o}, {m}) / nullif(stddev_pop({o}) * stddev_pop({m}), 0))"


SQL = {
    "RMSE": "sqrt(avg(power(m - o, 2)))", "MAE": "avg(abs(m - o))", "Bias": "avg(m - o)", "R": sql_pearson("o", "m"),
    "R2": f"power({sql_pearson('o', 'm')}, 2)", "MSE": "avg(power(m - o, 2))",
    "R2SS": "1 - sum(power(m - o, 2)) / nullif(count(m - o) * var_pop(CASE WHEN m IS NOT NULL THEN o END), 0)",
    "PHL": "avg(sqrt(1 + power(m - o, 2)) - 1)",
}


def sql_metrics(*names: str) -> str:
    return ", ".join(f'{SQL[n]} AS "{n}"' for n in names)


register("m01_rmse_mse_mae", lambda g: M.summarize_regression(g("skill"), "T3", MODELS, ["region"], ["RMSE", "MSE", "MAE"]), f"{LONG}\n--\nSELECT model, region, {sql_metrics('RMSE', 'MSE', 'MAE')} FROM long GROUP BY 1, 2", K, keys="model region", vals="RMSE MSE MAE")
register("m02_bias", lambda g: M.summarize_regression(g("skill"), "T3", MODELS, [], ["Bias"]), f"{LONG}\n--\nSELECT model, {sql_metrics('Bias')} FROM long GROUP BY 1", K, keys="model", vals="Bias")
register("m03_pearson", lambda g: M.summarize_regression(g("skill"), "T3", MODELS, ["site"], ["R"]), f"{LONG}\n--\nSELECT model, site, {sql_metrics('R')} FROM long GROUP BY 1, 2", K, keys="model", ints="site", vals="R")
register("m04_r2_score", lambda g: M.summarize_regression(g("skill"), "T3", MODELS, ["region"], ["R2SS"]), f"{LONG}\n--\nSELECT model, region, {sql_metrics('R2SS')} FROM long GROUP BY 1, 2", K, keys="model region", vals="R2SS")
register("m05_r_squared", lambda g: M.summarize_regression(g("skill"), "T3", MODELS, ["region"], ["R2"]), f"{LONG}\n--\nSELECT model, region, {sql_metrics('R2')} FROM long GROUP BY 1, 2", K, keys="model region", vals="R2")
register(
    "m06_nse", lambda g: M.nse(g("skill"), "T3", "physical_T3", ["region"]),
    "c AS (SELECT region, avg(physical_T3) AS c FROM skill GROUP BY 1)\n--\nSELECT k.region, 1 - sum(power(T3 - physical_T3, 2)) / nullif(sum(power(T3 - c, 2)), 0) AS NSE FROM skill k JOIN c ON k.region = c.region GROUP BY 1", K, keys="region", vals="NSE",
)
register(
    "m07_spearman", lambda g: M.spearman(g("skill"), "T3", "physical_T3", ["region"]),
    f"""r AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY T3) + (count(*) OVER (PARTITION BY region, T3) - 1) / 2e0 AS o, rank() OVER (PARTITION BY region ORDER BY physical_T3) + (count(*) OVER (PARTITION BY region, physical_T3) - 1) / 2e0 AS m FROM skill WHERE T3 IS NOT NULL AND physical_T3 IS NOT NULL)
--
SELECT region, {sql_pearson('o', 'm')} AS spearman FROM r GROUP BY 1""", K, keys="region", vals="spearman",
)
register("m08_pseudo_huber", lambda g: M.summarize_regression(g("skill"), "T3", MODELS, ["region"], ["PHL"]), f"{LONG}\n--\nSELECT model, region, {sql_metrics('PHL')} FROM long GROUP BY 1, 2", K, keys="model region", vals="PHL")
register(
    "m09_row_correlation", lambda g: M.row_correlation(g("skill").select("site", "time", "gbt_T3"), g("skill").groupBy("time").agg(F.avg("T3").alias("y")), "site", "time", "gbt_T3", "y"),
    f"yy AS (SELECT time AS t, avg(T3) AS target FROM skill GROUP BY 1)\n--\nSELECT site, {sql_pearson('target', 'gbt_T3')} AS R FROM skill JOIN yy ON time = t GROUP BY 1", K, ints="site", vals="R",
)
register("m10_summarize_regression", lambda g: M.summarize_regression(g("skill"), "T3", MODELS, ["region", "site"]), f"{LONG}\n--\nSELECT model, region, site, {sql_metrics('RMSE', 'MAE', 'Bias', 'R', 'R2')} FROM long GROUP BY 1, 2, 3", K, keys="model region", ints="site", vals="RMSE MAE Bias R R2")
EVENT = "e AS (SELECT model, region, count(*) FILTER (o <= -2 AND m <= -2) AS tp, count(*) FILTER (o > -2 AND m <= -2) AS fp, count(*) FILTER (o <= -2 AND m > -2) AS fn, count(*) FILTER (o > -2 AND m > -2) AS tn FROM long WHERE o IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2)"
register(
    "m11_event_skill", lambda g: M.event_skill(g("skill"), "T3", MODELS, -2.0, ["region"]),
    f'{LONG}, {EVENT}\n--\nSELECT model, region, tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) AS f1, (tp + tn) / nullif(tp + tn + fp + fn, 0) AS accuracy, tn / nullif(tn + fp, 0) AS tnr FROM e', K, keys="model region", ints="tp fp fn tn", vals="precision recall f1 accuracy tnr",
)
register(
    "m12_compare_models", lambda g: M.compare_models(g("skill"), "T3", MODELS, ["region"]),
    f"{LONG}, w AS (SELECT model, region, {sql_metrics('RMSE', 'MAE', 'Bias', 'R', 'R2')} FROM long GROUP BY 1, 2)\n--\n" + " UNION ALL ".join(f"SELECT model, region, '{n}' AS metric, \"{n}\" AS value FROM w" for n in ("RMSE", "MAE", "Bias", "R", "R2")), K, keys="model region metric", vals="value",
)
register("m13_metric_by_day", lambda g: P.clip_metric(M.metric_by(g("skill").withColumn("date", F.date_trunc("day", "time")), "T3", MODELS[:2], ["region", "date"]), MODELS[:2], -2, 15), """SELECT region, date_trunc('day', time) AS date, CASE WHEN sqrt(avg(power(gbt_T3 - T3, 2))) BETWEEN -2 AND 15 THEN sqrt(avg(power(gbt_T3 - T3, 2))) END AS gbt_T3, CASE WHEN sqrt(avg(power(lasso_T3 - T3, 2))) < 15 THEN sqrt(avg(power(lasso_T3 - T3, 2))) END AS lasso_T3 FROM skill GROUP BY 1, 2""", K, keys="region", times="date", vals="gbt_T3 lasso_T3")
HOUR = "h AS (SELECT region, time, sqrt(avg(power(gbt_T3 - T3, 2))) AS gbt_T3, sqrt(avg(power(coarse_T3 - T3, 2))) AS coarse_T3 FROM skill GROUP BY 1, 2)"
register("m14_metric_by_hour", lambda g: M.metric_by(g("skill"), "T3", ["gbt_T3", "coarse_T3"], ["region", "time"]), HOUR + "\n--\nSELECT * FROM h", K, keys="region", times="time", vals="gbt_T3 coarse_T3")
register(
    "m15_metric_by_hour_mean_regions", lambda g: P.clip_metric(M.metric_by(g("skill"), "T3", ["gbt_T3", "coarse_T3"], ["region", "time"]).groupBy("time").agg(F.avg("gbt_T3").alias("gbt_T3"), F.avg("coarse_T3").alias("coarse_T3")), ["gbt_T3", "coarse_T3"], -2, 12),
    HOUR + "\n--\nSELECT time, CASE WHEN avg(gbt_T3) < 12 THEN avg(gbt_T3) END AS gbt_T3, CASE WHEN avg(coarse_T3) < 12 THEN avg(coarse_T3) END AS coarse_T3 FROM h GROUP BY 1", K, times="time", vals="gbt_T3 coarse_T3",
)
register(
    "m16_skill_table", lambda g: M.skill_table(g("skill"), "T3", MODELS),
    "c AS (SELECT region AS cr, count(physical_T3) AS n FROM skill GROUP BY 1), s AS (SELECT * FROM skill JOIN c ON region = cr WHERE physical_T3 IS NOT NULL OR n = 0), long AS ("
    + " UNION ALL ".join(f"SELECT region, time, T3 AS o, '{m}' AS model, {m} AS m FROM s" for m in MODELS)
    + f") \n--\nSELECT region, g.g AS month_group, model, round({SQL['RMSE']}, 1) AS RMSE, round({SQL['R']}, 2) AS R FROM long JOIN (VALUES ('ALL', 1, 12), ('SUMMER', 5, 9)) g(g, a, b) ON month(time) BETWEEN a AND b GROUP BY 1, 2, 3", K, keys="region month_group model", vals="RMSE R",
)
register("a15_monthly_site_error", lambda g: A.monthly_site_error(g("skill"), "T3", MODELS), "SELECT month(time) AS month, site, " + ", ".join(f"avg({m} - T3) AS {m}" for m in MODELS) + " FROM skill GROUP BY 1, 2", K, ints="month site", vals=" ".join(MODELS))
register(
    "a16_monthly_metrics", lambda g: A.monthly_metrics(g("skill"), "T3", MODELS[:2]),
    "s AS (SELECT month(time) AS month, site, avg(T3) AS o, avg(gbt_T3) AS gbt_T3, avg(lasso_T3) AS lasso_T3 FROM skill GROUP BY 1, 2), long AS (SELECT month, o, 'gbt_T3' AS model, gbt_T3 AS m FROM s UNION ALL SELECT month, o, 'lasso_T3', lasso_T3 FROM s)"
    f"\n--\nSELECT model, month, {sql_metrics('Bias', 'MAE', 'RMSE', 'R')} FROM long GROUP BY 1, 2", K, keys="model", ints="month", vals="Bias MAE RMSE R",
)
register("a17_error_summary", lambda g: A.error_summary(g("skill"), "T3", MODELS), f"{LONG}\n--\nSELECT model, avg(m - o) AS mean, stddev_pop(m - o) AS std FROM long GROUP BY 1", K, keys="model", vals="mean std")
register("o06_melt", lambda g: M.long_models(g("skill"), "T3", MODELS, ["site", "time"]), f"{LONG}\n--\nSELECT site, time, model, o AS T3, m AS yhat FROM long", K, keys="model", times="time", ints="site", vals="T3 yhat")

# ---- pairs
PAIRS = "p AS (SELECT a.region AS ra, b.region AS rb, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d, a.r AS e1, b.r AS e2 FROM e a JOIN e b ON a.time = b.time AND a.site < b.site WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 10000)"
RES = "e AS (SELECT region, site, time, x, y, gbt_T3 - T3 AS r FROM skill WHERE gbt_T3 IS NOT NULL AND T3 IS NOT NULL), " + PAIRS
OBS = RES.replace("gbt_T3 - T3 AS r", "T3 AS r")
BINS = "SELECT b AS bin, avg(power(e1 - e2, 2) / 2) AS gamma, count(e1) AS n_pairs FROM (SELECT unnest(range(20)) AS b) LEFT JOIN p ON CAST(floor(d / 500) AS INT) = b GROUP BY 1"
register("v01_semivariogram", lambda g: V.semivariogram(g("skill"), "T3", "gbt_T3"), f"{RES}\n--\n{BINS}", K, ints="bin n_pairs", vals="gamma")
GREAT = "6371000 * 2 * atan2(sqrt(h), sqrt(1 - h))"
register(
    "v03_variogram_on_the_globe", lambda g: V.field_variogram(g("skill").withColumns({"lon": F.pmod(F.col("site") * 97.3, F.lit(360.0)) - 180.0, "lat": 90 - F.pmod(F.col("site") * 1.7, F.lit(11.0))}), "T3", 300_000, 12, prefer_xy=False),
    f"""e AS (SELECT site, time, T3, site * 97.3e0 - 360 * floor(site * 97.3e0 / 360) - 180 AS lon, 90 - (site * 1.7e0 - 11 * floor(site * 1.7e0 / 11)) AS lat FROM skill WHERE T3 IS NOT NULL),
hv AS (SELECT a.T3 AS e1, b.T3 AS e2, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM e a JOIN e b ON a.time = b.time AND a.site < b.site),
p AS (SELECT e1, e2, CAST(floor({GREAT} / 25000) AS INT) AS b FROM hv WHERE {GREAT} < 300000)
--
SELECT k AS bin, avg(power(e1 - e2, 2) / 2) AS gamma, count(e1) AS n_pairs FROM (SELECT unnest(range(12)) AS k) LEFT JOIN p ON b = k GROUP BY 1""", K, ints="bin n_pairs", vals="gamma",
)
register("v01_semivariogram_by_region", lambda g: V.semivariogram(g("skill"), "T3", "gbt_T3", by_region=True).filter("n_pairs > 0"), f"{RES}\n--\nSELECT ra AS region, CAST(floor(d / 500) AS INT) AS bin, avg(power(e1 - e2, 2) / 2) AS gamma, count(*) AS n_pairs FROM p WHERE ra = rb GROUP BY 1, 2", K, keys="region", ints="bin n_pairs", vals="gamma")
register("v02_sampled_semivariogram", lambda g: V.sampled_semivariogram(g("skill"), "T3", "gbt_T3"), None, K, ints="bin n_pairs", vals="gamma")
register("v03_field_variogram", lambda g: V.field_variogram(g("skill"), "T3", co_available="physical_T3"), f"{OBS.replace('FROM skill WHERE', 'FROM skill WHERE physical_T3 IS NOT NULL AND')}\n--\n{BINS}", K, ints="bin n_pairs", vals="gamma")
BOTH = RES + ", ev AS (" + BINS + "), " + OBS.replace("e AS (", "oe AS (", 1).replace("p AS (", "op AS (", 1).replace("FROM e a JOIN e b", "FROM oe a JOIN oe b") + ", ov AS (" + BINS.replace("LEFT JOIN p", "LEFT JOIN op p") + ")"
register("j04_attach_obs_variogram", lambda g: V.error_and_obs_variograms(g("skill"), "T3", "gbt_T3"), f"{BOTH}\n--\nSELECT bin, ev.gamma AS gamma_err, ov.gamma AS gamma_obs, ev.n_pairs AS err_count, ov.n_pairs AS obs_count FROM ev LEFT JOIN ov USING (bin)", K, ints="bin err_count obs_count", vals="gamma_err gamma_obs")
register("v04_scale_skill", lambda g: V.scale_skill(V.error_and_obs_variograms(g("skill"), "T3", "gbt_T3")), f"{BOTH}\n--\nSELECT bin, ev.gamma / ov.gamma AS ratio, 1 - ev.gamma / ov.gamma AS skill, sqrt(2 * ev.gamma) AS pair_rmse FROM ev LEFT JOIN ov USING (bin)", K, ints="bin", vals="ratio skill pair_rmse")
register("v05_site_demeaned_residuals", lambda g: V.site_demeaned_residuals(g("skill"), "T3", "gbt_T3", "demeaned"), "SELECT site, time, gbt_T3 - avg(gbt_T3 - T3) OVER (PARTITION BY site) AS demeaned FROM skill", K, times="time", ints="site", vals="demeaned")


#: Sites of a range, about; ranges at least.
_RANGE, _LEAST = 10_000, 8


def _pairs(g):
    """Every two sites of a region, once. Sites are cut into ranges by number, and a task holds the sites of two ranges
    and a region, so none grows with a region; their distances repeat, so that files hold them by dictionary."""
    sites = settle(g("sites"), "sites")
    ranges = max(_LEAST, -(-sites.count() // _RANGE))
    cut = settle(with_piece(sites, "site", pieces=ranges), "ranges").withColumnRenamed("_piece", "_r")
    steps = lambda lo, hi, name: F.explode(F.sequence(lo, hi)).alias(name)
    left = cut.select("*", F.col("_r").alias("_i"), steps(F.col("_r"), F.lit(ranges), "_j"))
    right = cut.select("*", F.col("_r").alias("_j"), steps(F.lit(0), F.col("_r"), "_i"))
    key = ["region", "_i", "_j"]
    tasks = max(sites.sparkSession.sparkContext.defaultParallelism, min(2000, ranges * ranges))
    both = left.repartition(tasks, *key).alias("a").join(right.repartition(tasks, *key).alias("b"), key).filter("a.site < b.site")
    return both.select(F.col("a.site").alias("s1"), F.col("b.site").alias("s2"), *(F.col(f"{t}.{c}").alias(f"{c}{k}") for t, k in (("a", 1), ("b", 2)) for c in ("lon", "lat", "x", "y")))


HAV = "power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)"
register(
    "v06_distances", lambda g: _pairs(g).withColumns({"great": D.haversine("lon1", "lat1", "lon2", "lat2"), "flat": D.equirectangular("lon1", "lat1", "lon2", "lat2"), "plane": D.planar("x1", "y1", "x2", "y2")}),
    f"SELECT a.site AS s1, b.site AS s2, 6371000 * 2 * atan2(sqrt({HAV}), sqrt(1 - ({HAV}))) AS great, 6371000 * sqrt(power(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + power(radians(b.lat - a.lat), 2)) AS flat, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS plane FROM sites a JOIN sites b ON a.region = b.region AND a.site < b.site", ["sites"], ints="s1 s2", vals="great flat plane", digits=3,
)
register("v07_grid_spacing", lambda g: D.grid_spacing(g("reanalysis")), "SELECT DISTINCT lat, lon, 6371000 * cos(radians(lat)) * radians(2) AS dx, 6371000 * radians(2) AS dy FROM reanalysis", ["reanalysis"], vals="lat lon dx dy", digits=3)

# ---- models
register("l01_holdout_split", lambda g: L.fold_roles(g("skill").withColumn("T1_offset", F.col("T3")), ["T1_offset", "physical_T3"]), """c AS (SELECT region, year(time) AS y, count(*) AS n FROM skill WHERE T3 IS NOT NULL AND physical_T3 IS NOT NULL GROUP BY 1, 2)
--
SELECT f.region AS fold_region, f.y AS fold_year, CASE WHEN f.region = c.region THEN 'validation' ELSE 'train' END AS role, sum(c.n) AS n FROM c f JOIN c ON (f.region = c.region AND f.y = c.y) OR (f.region <> c.region AND f.y <> c.y) GROUP BY 1, 2, 3""", K, keys="fold_region role", ints="fold_year n")
register("l02_week_folds", lambda g: L.week_folds(g("skill")).groupBy("foldCol").agg(F.count("*").alias("n"), F.count_distinct(F.weekofyear("time")).alias("weeks")), "SELECT CAST(('0x' || substr(md5(concat(CAST(week(time) AS VARCHAR), '|33')), 1, 6)) AS INT) % 3 AS foldCol, count(*) AS n, count(DISTINCT week(time)) AS weeks FROM skill GROUP BY 1", K, ints="foldCol n weeks")
register(
    "l08_model_for", lambda g: L.model_for(g("skill").withColumn("model_year", F.year("time")).groupBy("region", "model_year").agg(F.avg("gbt_T3").alias("m"), F.avg("T3").alias("t")).filter("m > t").select("region", "model_year").withColumn("model", F.concat_ws("_", "region", "model_year")), g("skill").select("region", F.year("time").alias("year")).distinct()),
    "r AS (SELECT region, year(time) AS model_year FROM skill GROUP BY 1, 2 HAVING avg(gbt_T3) > avg(T3)), w AS (SELECT DISTINCT region, year(time) AS year FROM skill)\n--\nSELECT region, year, model_year, concat(region, '_', model_year) AS model FROM (SELECT w.region, w.year, model_year, row_number() OVER (PARTITION BY w.region, w.year ORDER BY CASE WHEN year = model_year THEN 0 ELSE 1 END, md5(concat(w.region, '|', year, '|', model_year, '|5')), model_year) AS k FROM w JOIN r ON w.region = r.region) WHERE k = 1", K, keys="region model", ints="year model_year",
)
WEIGHTS = {"E5_skt_+000": 0.5, "E5_skt_-003": -0.2, "Cycle_ann_sin": 1.5, "St_x": 0.001, "lat": 0.3}
_linear = lambda g: L.linear_contributions(g("skill").select(F.col("coarse_T3").alias("E5_skt_+000"), F.col("gbt_T3").alias("E5_skt_-003"), F.sin("T3").alias("Cycle_ann_sin"), F.col("x").alias("St_x"), "lat"), WEIGHTS)
_terms = {"E5_skt_+000": "coarse_T3", "E5_skt_-003": "gbt_T3", "Cycle_ann_sin": "sin(T3)", "St_x": "x", "lat": "lat"}
RANK = "v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, ({_terms[f]}) * {w}e0 AS v FROM skill" for f, w in WEIGHTS.items()) + "), rk AS (SELECT feature, avg(abs(v - m)) AS importance FROM v JOIN (SELECT feature AS f, avg(v) AS m FROM v GROUP BY 1) ON feature = f GROUP BY 1)"
register("l09_attribution_rank", lambda g: L.attribution_rank(_linear(g)), RANK + "\n--\nSELECT * FROM rk", K, keys="feature", vals="importance")
register(
    "l10_attribution_by_variable", lambda g: L.attribution_by_variable(L.attribution_rank(_linear(g))),
    RANK + """, nm AS (SELECT CASE WHEN feature LIKE 'Cycle%' THEN 'cycle' WHEN feature LIKE 'E5%' THEN 'dynamic' ELSE 'static' END AS kind, CASE feature WHEN 'Cycle_ann_sin' THEN 'ann_sin' WHEN 'St_x' THEN 'x' WHEN 'lat' THEN 'lat' ELSE 'skt' END AS variable, CASE feature WHEN 'E5_skt_+000' THEN 0 WHEN 'E5_skt_-003' THEN -3 END AS lag, importance FROM rk)
--
SELECT kind, variable, lag, avg(importance) AS importance, count(*) AS n FROM nm GROUP BY GROUPING SETS ((kind), (kind, variable), (kind, lag))""", K, keys="kind variable", ints="lag n", vals="importance",
)

# two fixed trees over three columns: (tree, weight, node, feature, threshold, left, right, value)
TWO_TREES = [
    (0, 1.0, 0, 0, 0.0, 1, 4, 0.0), (0, 1.0, 1, 1, -5.0, 2, 3, 0.0), (0, 1.0, 2, -1, None, -1, -1, -4.0), (0, 1.0, 3, -1, None, -1, -1, 1.0),
    (0, 1.0, 4, 2, 3000.0, 5, 6, 0.0), (0, 1.0, 5, -1, None, -1, -1, 2.0), (0, 1.0, 6, -1, None, -1, -1, 5.0),
    (1, 0.1, 0, 1, 2.0, 1, 2, 0.0), (1, 0.1, 1, -1, None, -1, -1, -1.0), (1, 0.1, 2, 0, 10.0, 3, 4, 0.0), (1, 0.1, 3, -1, None, -1, -1, 3.0), (1, 0.1, 4, -1, None, -1, -1, 8.0),
]
TREE_FEATURES = ["coarse_T3", "gbt_T3", "x"]


def _two_trees(g):
    rows = g("skill").select("region", "site", "time", *TREE_FEATURES)
    trees = rows.sparkSession.createDataFrame(TWO_TREES, "tree int, weight double, node int, feature int, threshold double, left int, right int, value double")
    return B.tree_contributions(rows, ["region", "site", "time"], TREE_FEATURES, B.with_expectations(rows, TREE_FEATURES, trees, 2), 2, 0.5)


PATHS = """pt AS (SELECT region, site, time, coarse_T3 AS a, gbt_T3 AS b, x, CASE WHEN coarse_T3 <= 0 THEN CASE WHEN gbt_T3 <= -5 THEN -4 ELSE 1 END WHEN x <= 3000 THEN 2 ELSE 5 END AS l0, CASE WHEN gbt_T3 <= 2 THEN -1 WHEN coarse_T3 <= 10 THEN 3 ELSE 8 END AS l1 FROM skill WHERE coarse_T3 IS NOT NULL AND gbt_T3 IS NOT NULL AND x IS NOT NULL),
ex AS (SELECT avg(l0) AS r0, avg(l0) FILTER (a <= 0) AS n1, avg(l0) FILTER (a > 0) AS n4, avg(l1) AS r1, avg(l1) FILTER (b > 2) AS n2 FROM pt),
ct AS (SELECT region, site, time, CASE WHEN a <= 0 THEN n1 ELSE n4 END - r0 + CASE WHEN b > 2 THEN 0.1e0 * (l1 - n2) ELSE 0 END AS coarse_T3,
CASE WHEN a <= 0 THEN l0 - n1 ELSE 0 END + 0.1e0 * (CASE WHEN b > 2 THEN n2 ELSE -1 END - r1) AS gbt_T3, CASE WHEN a > 0 THEN l0 - n4 ELSE 0 END AS x, 0.5e0 + r0 + 0.1e0 * r1 AS base FROM pt, ex)"""
register("l09_tree_contributions", _two_trees, PATHS + "\n--\nSELECT * FROM ct", K, keys="region", times="time", ints="site", vals="coarse_T3 gbt_T3 x base")
register(
    "l09_tree_attribution_rank", lambda g: L.attribution_rank(_two_trees(g).select(*TREE_FEATURES)),
    PATHS + "\n--\n" + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs({f})) AS importance FROM ct" for f in TREE_FEATURES), K, keys="feature", vals="importance",
)


def _boosted_rank(g):
    train, check, features = _trees(g)
    model = L.boosted_offsets(train, features, ["T3_offset"], maxIter=5, maxDepth=4, stepSize=0.3)
    return L.attribution_rank(B.boosted_contributions(model, "T3_offset", train, check).select(*features))


def _trees(g):
    df = g("skill").withColumn("T3_offset", F.col("T3") - F.col("coarse_T3")).select("region", "site", "time", "x", "lat", "gbt_T3", "coarse_T3", "T3_offset", "T3")
    df = settle(df, "rows")  # read once for each pass of a fit
    train, check = L.holdout_split(df, "ASIA", 1997, ["T3_offset"])
    features = ["x", "lat", "gbt_T3", "coarse_T3"]
    return train, check, features


def _fit_chain(g):
    """Readings, coarse fields and sites to a saved model and its held-out skill."""
    spark, targets = g("skill").sparkSession, ["T3"]
    table, features = L.predictor_table(g("skill").select("region", "site", "time", "T3"), g("sites"), g("reanalysis"), ["skt", "t2m"], ["x", "y", "lat"], targets)
    table = settle(table.dropna(subset=features), "predictors")  # fitted and predicted from
    train, check = L.holdout_split(table, "ASIA", 1997, ["T3_offset"])
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    L.boosted_offsets(train, features, ["T3_offset"], maxIter=5, maxDepth=4, stepSize=0.3).save(spark, folder)
    predicted = L.predict_sites(L.OffsetModel.load(spark, folder), check, "skt_+000")
    return L.held_out_skill(predicted, check, "T3", "skt_+000")


register("l03_fit_chain", _fit_chain, None, ["skill", "reanalysis"], keys="region", ints="n", vals="corr_fit rmse_fit corr_raw rmse_raw")
register("l03_l06_boosted_offsets", lambda g: (lambda t, c, f: L.predict_sites(L.boosted_offsets(t, f, ["T3_offset"], maxIter=5, maxDepth=4, stepSize=0.3), c, "coarse_T3", kelvin=False))(*_trees(g)), None, K, keys="region", times="time", ints="site", vals="predicted_T3_offset predicted_T3")
register("l04_bagged_lasso", lambda g: (lambda t, c, f: L.bagged_lasso(t, f, ["site", "time"], ["T3_offset"], bags=50).transform(c))(*_trees(g)), None, K, keys="region", times="time", ints="site", vals="predicted_T3_offset")
def _lasso_moments(g):
    """One bag of all rows at a given penalty: its weights leave no slope steeper than the penalty."""
    train, _, features = _trees(g)
    model = L.bagged_lasso(train, features, ["site", "time"], ["T3_offset"], bags=1, row_share=1.0, feature_share=1.0, alpha=0.05)
    shaped = L.apply_normal(train, model.grids)
    (names, weights, start), = model.models["T3_offset"]
    rest = F.col("T3_offset") - start - sum((F.col(f) * w for f, w in zip(names, weights, strict=True)), F.lit(0.0))
    slopes = shaped.withColumn("_rest", rest).agg(*((F.covar_pop("_rest", f) / F.stddev_samp(f)).alias(f) for f in names))
    long = slopes.unpivot([], list(names), "feature", "slope")
    zero = F.create_map(*(x for f, w in zip(names, weights, strict=True) for x in (F.lit(f), F.lit(float(w)))))
    return long.select("feature", F.when(zero[F.col("feature")] == 0, F.abs("slope") <= 0.05 + 1e-6).otherwise(F.abs(F.abs("slope") - 0.05) < 1e-6).cast("int").alias("optimal"))


register("l04_lasso_optimality", _lasso_moments, "SELECT unnest(['x', 'lat', 'gbt_T3', 'coarse_T3']) AS feature, 1 AS optimal FROM (SELECT count(*) AS n FROM skill)", K, keys="feature", ints="optimal")
register("l05_tune", lambda g: (lambda t, c, f: U.tune(t, f, "T3_offset", {"maxDepth": [2, 4], "stepSize": [0.1, 0.3]}, 3, 2, base={"maxIter": 4, "maxDepth": 3}, eta=2, least=2)[1])(*_trees(g)), None, K, ints="number rung rounds round", vals="value")
def _all_folds(g):
    """Skill of a small model of every (region, year), beside the raw field."""
    df = g("skill").withColumn("T3_offset", F.col("T3") - F.col("coarse_T3")).select("region", "site", "time", "x", "lat", "gbt_T3", "coarse_T3", "T3_offset", "T3")
    features = ["x", "lat", "gbt_T3", "coarse_T3"]
    table = settle(L.put_together(df, features), "table")  # put together once for all folds
    fit = {"boosted": lambda train: L.boosted_offsets(train, features, ["T3_offset"], maxIter=1, maxDepth=3, stepSize=0.3)}
    return S.fit_folds(table, features, "T3", f"{shared_folder(df.sparkSession)}/folds-{uuid.uuid4().hex}", fit, "coarse_T3", kelvin=False)


RAW = f"""m AS (SELECT region, year(time) AS y, coarse_T3 AS m, T3 AS o FROM skill WHERE T3 IS NOT NULL AND coarse_T3 IS NOT NULL),
f AS (SELECT region, y, count(*) AS n, {sql_pearson('o', 'm')} AS corr_raw, sqrt(avg(power(m - o, 2))) AS rmse_raw FROM m GROUP BY 1, 2),
t AS (SELECT a.region AS tr, a.y AS ty, sum(b.n) AS n_train FROM f a JOIN f b ON a.region <> b.region AND a.y <> b.y GROUP BY 1, 2)"""
register(
    "l06_all_folds", _all_folds, f"{RAW}\n--\nSELECT region, y AS model_year, 'boosted' AS kind, n_train, n, corr_raw, rmse_raw FROM f JOIN t ON region = tr AND y = ty",
    K, keys="region kind", ints="model_year n_train n", vals="corr_raw rmse_raw",
)
register("l09_boosted_attribution", _boosted_rank, None, K, keys="feature", vals="importance")
register("l11_partial_dependence", lambda g: (lambda t, c, f: L.partial_dependence(L.boosted_offsets(t, f, ["T3_offset"], maxIter=4, maxDepth=3), P.row_sample(t, 2000, ["site", "time"]), "coarse_T3", "T3_offset", 20))(*_trees(g)), None, K, vals="coarse_T3 prediction")
register("l12_pca", lambda g: L.components_of(L.pca(g("skill"), MODELS, 2)[0], 2).select("site", "time", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2")), None, K, times="time", ints="site", vals="pc1 pc2")
register("l13_cluster_regimes", lambda g: G.cluster_regimes(g("skill"), ["T3", "gbt_T3", "coarse_T3"], 3).groupBy("region", "cluster").count(), None, K, keys="region", ints="cluster count")


def _centred(g):
    """Of all sites with rows enough: each row's own cluster mean is the nearest of its site's."""
    cols = ["T3", "gbt_T3"]
    found = settle(G.cluster_regimes(g("skill").select("region", "site", "time", *cols), cols, 2, 30, by="site", rounds=None, tolerance=1e-9), "found")
    stats = found.groupBy("site").agg(*(F.stddev_samp(c).alias(f"s_{c}") for c in cols))
    means = found.groupBy("site", "cluster").agg(*(F.avg(c).alias(f"m_{c}") for c in cols))
    met = found.select("region", "site", "time", "cluster", *cols).join(means.withColumnRenamed("cluster", "other"), "site").join(stats, "site")
    d = sum((F.pow((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 2) for c in cols), F.lit(0.0))
    best = met.withColumn("d", d).groupBy("region", "site", "time").agg(F.min("d").alias("least"), F.min(F.when(F.col("cluster") == F.col("other"), F.col("d"))).alias("own"))
    return best.groupBy("site").agg(F.count("*").alias("n"), F.sum((F.col("own") > F.col("least") + 1e-2).cast("int")).alias("misplaced"))


register("l13_site_regimes", _centred, "SELECT site, count(*) AS n, 0 AS misplaced FROM skill WHERE T3 IS NOT NULL AND gbt_T3 IS NOT NULL GROUP BY 1 HAVING count(*) >= 30", K, ints="site n misplaced")

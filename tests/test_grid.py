import numpy as np
from pyspark.sql import functions as F

from nivalis.functions import physics as D
from nivalis.operators import interpolate as I
from nivalis.operators import pairs as V
from nivalis.operators import select as P
from nivalis.operators import terrain as T


def grid(spark, ny=9, nx=12, holes=True):
    rng = np.random.default_rng(3)
    z = rng.uniform(0, 100, (ny, nx))
    if holes:
        z[2, 3] = z[5, 0] = np.nan
    rows = [("R", i, j, -10.0 * i, 10.0 * j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(ny) for j in range(nx)]
    return z, spark.createDataFrame(rows, "region string, iy int, ix int, y double, x double, dem10m double")


def as_array(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.select("iy", "ix", value).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


def test_box_mean_equals_a_loop_for_odd_and_even_windows(spark):
    z, df = grid(spark)
    for win in (3, 4, 20):
        want = np.full_like(z, np.nan)
        for i in range(z.shape[0]):
            for j in range(z.shape[1]):
                part = [z[min(max(i + a, 0), z.shape[0] - 1), min(max(j + b, 0), z.shape[1] - 1)] for a in range(-(win // 2), win - win // 2) for b in range(-(win // 2), win - win // 2)]
                want[i, j] = np.nanmean(part)
        assert np.allclose(as_array(T.box_mean(df, ["dem10m"], win), "dem10m", z.shape), want)


def test_gaussian_wraps_around(spark):
    z, df = grid(spark)
    k = np.arange(-20, 21)
    w = np.exp(-0.5 * (k / 5.0) ** 2)
    num, den = np.nan_to_num(z), (~np.isnan(z)).astype(float)
    for axis in (0, 1):
        num = sum(a * np.roll(num, -b, axis) for a, b in zip(w, k, strict=True))
        den = sum(a * np.roll(den, -b, axis) for a, b in zip(w, k, strict=True))
    assert np.allclose(as_array(T.gaussian_smooth_2d(df, "dem10m", 5.0), "smooth", z.shape), num / den)


def test_gradient_equals_numpy(spark):
    z, df = grid(spark, holes=False)
    gy, gx = np.gradient(z)
    out = T.gradient_slope(df)
    assert np.allclose(as_array(out, "slope_x", z.shape), np.arctan(gx / 10)) and np.allclose(as_array(out, "slope_y", z.shape), np.arctan(gy / -10))
    swapped = T.gradient_slope(df, swap_steps=True)
    assert np.allclose(as_array(swapped, "slope_x", z.shape), np.arctan(gx / -10))


def test_blackman_equals_a_convolution(spark):
    z, df = grid(spark, holes=False)
    for n in (3, 6):
        kernel = np.outer(np.blackman(n), np.blackman(n))
        kernel /= kernel.sum()
        wide = np.zeros((z.shape[0] + n - 1, z.shape[1] + n - 1))
        for i in range(n):
            for j in range(n):
                wide[i : i + z.shape[0], j : j + z.shape[1]] += kernel[i, j] * z
        a = (n - 1) // 2
        want = wide[a : a + z.shape[0], a : a + z.shape[1]]
        assert np.allclose(as_array(T.kernel_smooth(df, ["dem10m"], n), "dem10m", z.shape), want)


def test_bilinear_is_exact_on_a_plane_and_null_outside(spark):
    _, df = grid(spark)
    plane = df.withColumn("p", 2 * F.col("x") - 3 * F.col("y") + 1)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 110.0, -80.0), (3, 34.5, -71.2), (4, 111.0, -5.0), (5, 5.0, 1.0), (6, 34.0, -24.0)], "site int, x double, y double")
    got = {r.site: r.p for r in I.interp_bilinear(points, plane, "p").collect()}
    assert got[4] is None and got[5] is None
    for s, x, y in ((1, 0.0, 0.0), (2, 110.0, -80.0), (3, 34.5, -71.2), (6, 34.0, -24.0)):
        assert abs(got[s] - (2 * x - 3 * y + 1)) < 1e-9
    assert I.interp_bilinear(points.filter("site = 6"), df, "dem10m").first().dem10m is None  # a corner is missing


def test_thinning_is_minimal(spark):
    _, df = grid(spark, 20, 30)
    out = P.thin_grid(df, 100)
    assert out.count() == 7 * 10  # stride 3; stride 2 would leave 150
    assert P.thin_grid(df.limit(0), 5).count() == 0


def test_projection_goes_there_and_back(spark):
    row = D.project_tm35fin(spark.createDataFrame([(500000.0, 7700000.0), (300000.0, 7650000.0)], "x double, y double")).collect()
    assert abs(row[0].lon - 27.0) < 1e-12
    n = 1 / 298.257222101 / (2 - 1 / 298.257222101)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    lat, lon = np.radians(row[1].lat), np.radians(row[1].lon - 27)
    e = 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(lat)) - e * np.arctanh(e * np.sin(lat)))
    xi, eta = np.arctan2(t, np.cos(lon)), np.arctanh(np.sin(lon) / np.sqrt(1 + t * t))
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    x = 500000 + 0.9996 * a * (eta + sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(alpha, 1)))
    y = 0.9996 * a * (xi + sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(alpha, 1)))
    assert abs(x - 300000) < 2e-3 and abs(y - 7650000) < 2e-3


def test_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(h), int(s), float(x), float(y), float(v)) for h in range(3) for s, (x, y, v) in enumerate(rng.uniform(0, 30000, (40, 3)))]
    df = spark.createDataFrame(rows, "h int, site int, x double, y double, v double").withColumn("time", F.timestamp_seconds(F.col("h") * 3600))
    got = {r.bin: (r.n_pairs, r.gamma) for r in V.field_variogram(df, "v", 10_000, 5).collect()}
    want: dict = {b: [] for b in range(5)}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and (d := np.hypot(a[2] - b[2], a[3] - b[3])) < 10_000:
                want[int(d // 2000)].append((a[4] - b[4]) ** 2 / 2)
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(abs(got[k][1] - np.mean(v)) < 1e-3 for k, v in want.items() if v)


def test_no_python_in_plans(spark):
    _, df = grid(spark)
    plan = T.terrain_features(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivalis.operators import linepass as P
from nivalis.operators import terrain as T


def line(spark, values, begin=0):
    rows = spark.createDataFrame([("R", 0, begin + k, None if np.isnan(v) else float(v)) for k, v in enumerate(values)], "region string, iy int, ix int, v double")
    return rows.repartition(3)


def read(df, n, begin=0):
    out = np.full(n, np.nan)
    rows = df.select("ix", "v").collect()
    assert len(rows) == n
    for r in rows:
        out[r.ix - begin] = np.nan if r.v is None else r.v
    return out


def want_box(v, win):
    lo = win // 2
    wide = np.concatenate((np.full(lo, v[0]), v, np.full(win - 1 - lo, v[-1])))
    total = np.concatenate(([0.0], np.cumsum(wide)))
    return total[win:] - total[:-win]


@pytest.mark.parametrize(("n", "win", "tile", "begin"), [(40, 2, 8, 0), (40, 3, 7, 5), (41, 50, 8, -13), (300, 50, 64, 2), (9, 50, None, 0), (1, 3, None, 4), (1000, 501, 100, 0)])
def test_running_sums_equal_direct_ones(spark, n, win, tile, begin):
    v = np.random.default_rng(n + win).normal(0, 10, n)
    got = read(P.box_pass(line(spark, v, begin), ["region", "iy"], "ix", ["v"], win, tile), n, begin)
    assert np.allclose(got, want_box(v, win), atol=1e-9)


def test_a_long_line_is_cut_and_its_sums_stay(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("R").alias("region"), F.lit(0).alias("iy"), F.col("id").cast("int").alias("ix"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("v"))
    v = read(df, n)
    for win in (2, 3, 50, 501):
        out = P.box_pass(df, ["region", "iy"], "ix", ["v"], win)
        assert np.allclose(read(out, n), want_box(v, win), atol=1e-6)
    lo, weights = P.gaussian_weights(5.0)
    assert np.allclose(read(P.line_pass(df, ["region", "iy"], "ix", ["v"], lo, weights, "wrap"), n), sum(w * np.roll(v, -(lo + k)) for k, w in enumerate(weights)))
    tiles = P._tiled(df, ["region", "iy"], "ix", ["v"], 250, 250, P.TILE).groupBy("_tile").count()
    assert tiles.agg(F.max("count")).first()[0] <= P.TILE + 500


@pytest.mark.parametrize("mode", ["wrap", "nearest", "zero"])
def test_weighted_sums_of_tiles_equal_those_of_the_line(spark, mode):
    rng = np.random.default_rng(3)
    for n, begin in ((30, 4), (5, 0), (1, 2)):
        v = rng.normal(0, 3, n)
        v[n // 2] = np.nan if n > 1 else v[0]
        lo, weights = -4, list(map(float, rng.uniform(0, 1, 8)))
        ends = {"wrap": {"mode": "wrap"}, "nearest": {"mode": "edge"}, "zero": {"mode": "constant"}}[mode]
        wide = np.pad(v, 12, **ends)
        want = np.array([sum(w * wide[12 + i + lo + k] for k, w in enumerate(weights)) for i in range(n)])
        for tile in (None, 6):
            got = read(P.line_pass(line(spark, v, begin), ["region", "iy"], "ix", ["v"], lo, weights, mode, tile), n, begin)
            assert np.allclose(got, want, equal_nan=True)


def test_static_predictors_are_those_of_the_single_operators(spark):
    rng = np.random.default_rng(5)
    rows = [("R", i, j, -10.0 * i, 10.0 * j, None if (i, j) == (2, 3) else float(rng.uniform(0, 100)), *map(float, rng.uniform(0, 1, 3)), *map(float, rng.uniform(0, 40, 2)), *map(float, rng.uniform(0, 360, 2))) for i in range(6) for j in range(7)]
    names = ["norm_height", "mbi", "svf", "slope_degrees_w3", "slope_degrees_w4", "aspect_degrees_w3", "aspect_degrees_w4"]
    df = spark.createDataFrame(rows, "region string, iy int, ix int, y double, x double, dem10m double, " + ", ".join(f"{n} double" for n in names))
    keys = ["region", "iy", "ix"]
    whole = T.static_predictors(df, (3, 4)).orderBy(*keys).toPandas()
    single = [T.ruggedness(df, 3), T.ruggedness(df, 4), T.openness(df, 3), T.openness(df, 4), T.cold_air_pooling(df), T.cold_bias(df)]
    single += [T.vector_ruggedness(df, w, f"slope_degrees_w{w}", f"aspect_degrees_w{w}") for w in (3, 4)]
    for made in single:
        own = made.orderBy(*keys).toPandas()
        for c in set(own.columns) - set(df.columns):
            assert np.allclose(whole[c].astype(float), own[c].astype(float), equal_nan=True), c
    assert not [c for c in whole.columns if c.startswith("_")]

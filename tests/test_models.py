from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivalis.plans import modelling as L
from nivalis.sources import io

FEATURES = ["a", "b", "skt"]


@pytest.fixture(scope="module")
def table(spark):
    """Readings that lie off a coarse field by a function of two predictors."""
    rng = np.random.default_rng(8)
    rows = []
    for region in ("R", "S", "T"):
        for year in (2020, 2021):
            for k in range(200):
                a, b, skt = rng.uniform(-1, 1), rng.uniform(0, 5), 270 + rng.normal(0, 5)
                off = 3 * (a > 0) - 0.8 * b + rng.normal(0, 0.3)
                rows.append((region, k % 20, f"{year}-0{1 + k % 9}-1{k % 7} 0{k % 10}:00:00", a, b, skt, skt - 273.15 + off, off))
    df = spark.createDataFrame(rows, "region string, site int, t string, a double, b double, skt double, T3 double, T3_offset double")
    return df.withColumn("time", F.to_timestamp("t")).drop("t").dropDuplicates(["region", "site", "time"]).cache()


def test_normal_quantile_and_places(spark):
    values = [(float(v),) for v in np.random.default_rng(2).gamma(2, 3, 400)]
    shaped, grids = L.to_normal(spark.createDataFrame(values, "v double").withColumn("w", F.col("v")), ["w"], grid=20)
    g = np.array(grids["w"])
    for v, w in shaped.collect():
        p = np.clip(np.interp(v, g, np.linspace(0, 1, len(g))), 1e-7, 1 - 1e-7)
        assert abs(w - NormalDist().inv_cdf(float(p))) < 2e-3 or p in (1e-7, 1 - 1e-7) and abs(w) > 5
    flat = L.apply_normal(spark.createDataFrame([(1.0,), (2.0,)], "c double"), {"c": [1.0, 1.0, 1.0]})
    assert [abs(r.c) < 1e-3 for r in flat.collect()] == [True, True]


def test_bagged_lasso_equals_numpy(spark, table):
    """One bag of all rows and features is a lasso on standardised columns: check its optimality."""
    model = L.bagged_lasso(table, FEATURES, ["region", "site", "time"], ["T3_offset"], bags=1, row_share=1.0, feature_share=1.0, alpha=0.05)
    (names, weights, intercept), = model.models["T3_offset"]
    shaped = L.apply_normal(table, model.grids).select(*names, "T3_offset").toPandas()
    x, y = shaped[names].to_numpy(), shaped["T3_offset"].to_numpy()
    z, w, s = (x - x.mean(0)) / x.std(0, ddof=1), np.array(weights) * x.std(0, ddof=1), y.std(ddof=1)
    slope = z.T @ ((y - y.mean()) / s - z @ (w / s)) / len(y)  # of the loss by each weight
    assert np.all(np.abs(slope[w == 0]) <= 0.05 / s + 1e-2) and np.allclose(slope[w != 0], np.sign(w[w != 0]) * 0.05 / s, atol=1e-2)
    assert abs(intercept - (y - x @ np.array(weights)).mean()) < 1e-6
    got = model.transform(table).agg(F.corr("predicted_T3_offset", "T3_offset")).first()[0]
    assert got > 0.8


def test_models_come_back_from_disk(spark, table, tmp_path):
    trees = L.boosted_offsets(table, FEATURES, ["T3_offset"], maxIter=3, maxDepth=3)
    bags = L.bagged_lasso(table, FEATURES, ["region", "site", "time"], ["T3_offset"], bags=2)
    for model in (trees, bags):
        for _ in range(2):  # the second time over the first
            model.save(spark, str(tmp_path / "m"))
        again = type(model).load(spark, str(tmp_path / "m"))
        both = [m.transform(table).orderBy("region", "site", "time").select("predicted_T3_offset").toPandas() for m in (model, again)]
        assert np.allclose(both[0], both[1])
        tmp_path = tmp_path / "next"


def test_fit_beats_the_raw_field_on_held_out_rows(table):
    train, check = L.holdout_split(table, "R", 2021, ["T3_offset"])
    assert {(r.region, r.y) for r in check.select("region", F.year("time").alias("y")).distinct().collect()} == {("R", 2021)}
    assert not {(r.region, r.y) for r in train.select("region", F.year("time").alias("y")).distinct().collect()} & {("R", 2020), ("S", 2021), ("T", 2021)}
    for model in (
        L.boosted_offsets(train, FEATURES, ["T3_offset"], maxIter=20, maxDepth=4, stepSize=0.3),
        L.bagged_lasso(train, FEATURES, ["region", "site", "time"], ["T3_offset"], bags=3, feature_share=1.0),
    ):
        found = L.held_out_skill(L.predict_sites(model, check), check, "T3", "skt").first()
        assert found.rmse_fit < 0.8 * found.rmse_raw and found.corr_fit > found.corr_raw


def test_partial_dependence_follows_the_step(table):
    model = L.boosted_offsets(table, FEATURES, ["T3_offset"], maxIter=15, maxDepth=3, stepSize=0.3)
    found = {r.a: r.prediction for r in L.partial_dependence(model, table, "a", "T3_offset", 5).collect()}
    low, high = (np.mean([p for a, p in found.items() if (a > 0.2) == side and abs(a) > 0.2]) for side in (False, True))
    assert len(found) == 5 and 2 < high - low < 4


def test_components_equal_numpy(spark):
    x = np.random.default_rng(3).normal(0, [5, 2, 0.1], (60, 3)) @ np.array([[1, 2, 0], [0, 1, 1], [1, 0, 1.0]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "p double, q double, r double")
    made = L.components_of(L.pca(df, ["p", "q", "r"], 2)[0], 2).select("pc1", "pc2").toPandas().to_numpy()
    centred = x - x.mean(0)
    want = centred @ np.linalg.svd(centred)[2][:2].T
    assert np.allclose(np.abs(made), np.abs(want), atol=1e-6)


def test_model_output_at_sites(spark):
    cube = spark.createDataFrame([(f"2020-01-0{d} 00:00:00", float(y), float(x), 100.0 * d + 10 * y + x) for d in (1, 2) for y in range(3) for x in range(4)], "t string, y double, x double, v double")
    cube = cube.withColumn("time", F.to_timestamp("t")).drop("t")
    sites = spark.createDataFrame([(1, 0.5, 1.5), (2, 9.0, 0.0)], "site int, x double, y double")
    evaluation = spark.createDataFrame([(1, "2020-01-02 00:00:00"), (1, "2020-01-03 00:00:00"), (2, "2020-01-01 00:00:00"), (7, "2020-01-01 00:00:00")], "site int, t string").withColumn("time", F.to_timestamp("t"))
    got = {(r.site, r.t): r.m for r in io.read_model_output_at_sites(cube, sites, evaluation, "v", "m").collect()}
    assert got == {(1, "2020-01-02 00:00:00"): 215.5, (1, "2020-01-03 00:00:00"): None, (2, "2020-01-01 00:00:00"): None, (7, "2020-01-01 00:00:00"): None}


def test_hours_of_a_predictor_table_are_made_once(spark):
    """Values are linear in the cube; no medians are left in the plan."""
    hours = [f"2020-01-01 {h:02d}:00:00" for h in range(12)]
    stamp = lambda df: df.withColumn("time", F.to_timestamp("t")).drop("t")
    cube = stamp(spark.createDataFrame([(t, 60.0 + i, 20.0 + j, 270.0 + h + 2 * i + 3 * j) for h, t in enumerate(hours) for i in (0, 1) for j in (0, 1)], "t string, lat double, lon double, skt double"))
    sites = spark.createDataFrame([(1, 60.25, 20.5), (2, 60.0, 21.0), (3, 70.0, 20.5)], "site int, lat double, lon double")
    readings = stamp(spark.createDataFrame([("R", s, t[:-5] + m, float(v)) for s in (1, 2, 3) for t in hours for m, v in (("00:00", 1), ("10:00", 5), ("20:00", 2))], "region string, site int, t string, T3 double"))
    table, features = L.predictor_table(readings, sites, cube, ["skt"], ["lat"], ["T3"])
    rows = {(r["site"], r["time"].hour): r for r in table.collect()}
    assert len(rows) == 36 and all(r["T3"] == 2.0 for r in rows.values())
    for (s, h), r in rows.items():
        want = None if s == 3 else 270.0 + h + {1: 2.0, 2: 3.0}[s]
        assert r["skt_+000"] == want if want is None else np.isclose(r["skt_+000"], want)
        assert want is None or np.isclose(r["T3_offset"], 2.0 - want + 273.15)
    assert {"skt_+000", "skt_-003", "lat"} <= set(features)
    plan = table._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median" not in plan and "percentile" not in plan

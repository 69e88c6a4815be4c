import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from nivalis.plans import modelling as L
from nivalis.plans import tuning as U

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = [(f"2020-0{1 + k % 9}-1{k % 7} 0{k % 10}:00:00", *map(float, rng.uniform(-1, 1, 2))) for k in range(400)]
    df = spark.createDataFrame([(*r, 3.0 * (r[1] > 0) + r[2] + float(rng.normal(0, 0.5))) for r in data], "t string, a double, b double, y double")
    return df.withColumn("time", F.to_timestamp("t")).drop("t").cache()


def rmse(model, df):
    return model.transform(df).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]


def test_a_curve_has_the_error_of_every_shorter_model(rows):
    shaped = L.feature_vector(FEATURES).transform(rows)
    settings = L.TREES | {"maxDepth": 3, "stepSize": 0.3}
    part, check = shaped.filter("a < 0.5"), shaped.filter("a >= 0.5")
    curve = U.validation_curve(GBTRegressor(labelCol="y", **(settings | {"maxIter": 4})).fit(part), FEATURES, check, "y")
    assert len(curve) == 4
    for n in (1, 2, 4):
        assert np.isclose(curve[n - 1], rmse(GBTRegressor(labelCol="y", **(settings | {"maxIter": n})).fit(part), check))


def test_scores_are_the_best_rounds_and_rungs_drop_the_worse(rows):
    best, table = U.tune(rows, FEATURES, "y", {"maxDepth": [1, 4], "stepSize": [0.05, 0.5]}, 4, 2, base={"maxIter": 6, "maxDepth": 2}, eta=2, least=3)
    found = table.orderBy("rung", "number").collect()
    assert found[0].number == 0 and found[0].params == {"maxIter": 6.0, "maxDepth": 2.0}  # the defaults come first
    first, last = [r for r in found if r.rung == 0], [r for r in found if r.rung == 1]
    assert len(first) == 4 and {r.rounds for r in first} == {3} and {r.rounds for r in last} == {6}
    kept = {r.number for r in sorted(first, key=lambda r: (r.value, r.number))[:2]} | {0}
    assert {r.number for r in last} == kept
    winner = min(last, key=lambda r: (r.value, r.number))
    assert best["maxIter"] == winner.round and all(float(best[k]) == v for k, v in winner.params.items() if k != "maxIter")
    folded = L.feature_vector(FEATURES).transform(L.week_folds(rows, 2, 33))
    settings = L.TREES | {k: int(v) if k != "stepSize" else v for k, v in winner.params.items()} | {"maxIter": 6}
    curves = []
    for k in range(2):  # brute force over rounds
        model = GBTRegressor(labelCol="y", **settings).fit(folded.filter(F.col("foldCol") != k))
        mse = model.evaluateEachIteration(folded.filter(F.col("foldCol") == k), "squared")
        curves.append(np.sqrt(mse))
    assert np.isclose(winner.value, np.mean([c.min() for c in curves])) and winner.round == int(np.argmin(np.mean(curves, axis=0))) + 1


def test_rows_go_down_the_trees_without_a_row_for_each_round(rows, monkeypatch):
    shaped = L.feature_vector(FEATURES).transform(rows)
    model = GBTRegressor(labelCol="y", **(L.TREES | {"maxDepth": 3, "stepSize": 0.3, "maxIter": 5})).fit(shaped)
    lacking = rows.sparkSession.createDataFrame([(None, 0.1, 1.0), (float("nan"), 0.1, 1.0), (0.1, 0.1, None)], "a double, b double, y double")
    monkeypatch.setattr(F, "posexplode", lambda *a: pytest.fail("a row for each round"))
    curve = U.validation_curve(model, FEATURES, rows.select("a", "b", "y").unionByName(lacking), "y")
    assert np.allclose(curve, np.sqrt(model.evaluateEachIteration(shaped, "squared")))
    assert U.validation_curve(model, FEATURES, rows.filter("a > 5"), "y") == []


def test_the_defaults_are_fitted_once_and_rows_lie_by_fold(rows, monkeypatch):
    fits, laid, settle, fit = [], [], U.settle, GBTRegressor.fit
    monkeypatch.setattr(U, "settle", lambda df, what, **k: laid.append((df.columns, k)) or settle(df, what, **k))
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: fits.append((self.getMaxDepth(), self.getMaxIter())) or fit(self, df))
    U.tune(rows, FEATURES, "y", {"maxDepth": [1]}, 3, 2, base={"maxIter": 4, "maxDepth": 2}, eta=2, least=1)
    assert [x for x in fits if x[0] == 2] == [(2, 4)] * 2  # a fit for each fold, in none of the three rungs again
    assert laid == [(["a", "b", "label", "foldCol"], {"by": ["foldCol"]})]

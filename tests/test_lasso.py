import numpy as np
import pytest
from pyspark.sql import functions as F

from nivalis.plans import lasso
from nivalis.plans import modelling as L

FEATURES, TARGETS, KEYS = ["a", "b", "c", "d", "flat"], ["u", "v"], ["site"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, [1, 2, 0.5, 1], (500, 4))
    x[:, 3] += x[:, 0]
    data = [(k, *map(float, r), 4.0, float(2 * r[0] - r[1] + rng.normal()), None if k % 9 == 3 else float(r[2] + rng.normal(0, 0.2))) for k, r in enumerate(x)]
    return spark.createDataFrame(data, "site int, a double, b double, c double, d double, flat double, u double, v double").cache()


def solve(x, y, penalty):
    """Plain coordinate descent on rows."""
    s = x.std(0, ddof=1)
    s[s < 1e-12] = np.inf
    z, w = (x - x.mean(0)) / s, np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            own = z[:, j] @ z[:, j] / len(y)
            pull = z[:, j] @ (y - y.mean() - z @ w) / len(y) + own * w[j]
            w[j] = np.sign(pull) * max(abs(pull) - penalty, 0) / own if own else 0
    w = w / s
    return w, y.mean() - x.mean(0) @ w


def test_statistics_are_sums_of_products(rows):
    stats = lasso.group_statistics(rows, FEATURES, TARGETS, KEYS, 7, 1)
    data = rows.withColumn("g", lasso.row_group(KEYS, 7, 1)).toPandas()
    for g in range(7):
        for k, t in enumerate(TARGETS):
            own = data[(data["g"] == g) & data[t].notna()]
            z = np.column_stack((np.ones(len(own)), own[FEATURES], own[t]))
            assert np.allclose(stats[g, k], z.T @ z)


def test_penalty_and_weights_equal_those_from_rows(rows, monkeypatch):
    seen, whole = [], lasso.group_statistics
    monkeypatch.setattr(lasso, "group_statistics", lambda *a: seen.append(1) or whole(*a))
    model = L.bagged_lasso(rows, FEATURES, KEYS, TARGETS, bags=4, groups=12, penalties=12, seed=3)
    assert len(seen) == 1  # one aggregate for all bags, folds and targets
    data = L.apply_normal(rows, model.grids).withColumn("g", lasso.row_group(KEYS, 12, 3)).toPandas()
    import random

    rng = random.Random(3)
    for b in range(4):
        names = [FEATURES[k] for k in sorted(rng.sample(range(5), 3))]
        groups = rng.sample(range(12), 7)
        for t in TARGETS:
            own = data[data["g"].isin(groups) & data[t].notna()]
            x, y, fold = own[names].to_numpy(), own[t].to_numpy(), own["g"].map({g: k % 3 for k, g in enumerate(groups)}).to_numpy()
            s = x.std(0, ddof=1)
            s[s < 1e-12] = np.inf
            top = np.abs(((x - x.mean(0)) / s).T @ (y - y.mean()) / len(y)).max()
            error = []
            for p in top * np.logspace(0, -3, 12):
                folds = []
                for k in range(3):
                    w, c = solve(x[fold != k], y[fold != k], p)
                    folds.append(np.mean((y[fold == k] - x[fold == k] @ w - c) ** 2))
                error.append(np.mean(folds))
            best = top * np.logspace(0, -3, 12)[int(np.argmin(error))]
            assert np.isclose(model.penalties[t][b], best)
            got_names, got_weights, got_start = model.models[t][b]
            w, c = solve(x, y, best)
            assert got_names == names and np.allclose(got_weights, w, atol=1e-6) and np.isclose(got_start, c, atol=1e-6)


def test_the_chosen_penalty_keeps_what_matters(rows):
    model = L.bagged_lasso(rows, FEATURES, KEYS, ["u"], bags=20, feature_share=1.0)
    out = model.transform(rows).agg(F.corr("predicted_u", "u"), F.count("predicted_u")).first()
    assert out[0] > 0.85 and out[1] == 500
    assert all(w[FEATURES.index("flat")] == 0 for _, w, _ in model.models["u"])
    assert len(set(model.penalties["u"])) > 1


def test_places_among_quantiles_are_searched_not_filtered(spark):
    from nivalis.plans import modelling

    grid = [0.0, 0.0, 1.0, 2.0, 2.0, 5.0]
    values = [-1.0, 0.0, 0.5, 1.0, 1.999, 2.0, 3.5, 5.0, 9.0, float("nan"), None]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "i int, a double, flat double")
    out = modelling.apply_normal(df, {"a": grid, "flat": [3.0, 3.0]})
    assert out.columns == ["i", "a", "flat"] and "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    at = [0, 0.2, 0.3, 0.4, 0.5998, 0.8, 0.9, 1, 1, 1, None]
    want = spark.createDataFrame([(i, None if p is None else float(p)) for i, p in enumerate(at)], "i int, p double").select(modelling.normal_quantile(modelling.F.col("p"))).orderBy("i")
    got = [r["a"] for r in out.orderBy("i").collect()]
    assert np.allclose(got, [w[0] for w in want.collect()], atol=1e-9, rtol=0)
    assert out.filter("flat is null").count() == 0

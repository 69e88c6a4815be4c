import numpy as np
import pytest
from pyspark.sql import functions as F

from nivalis.plans import attribution as B
from nivalis.plans import modelling as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [(f"R{k % 3}", k, *map(float, rng.uniform(-1, 1, 3))) for k in range(600)]
    df = spark.createDataFrame([(*r, 3.0 * (r[2] > 0) - r[3] * r[2] + 5) for r in data], "region string, site int, a double, b double, c double, T3_offset double")
    return df.cache()


def test_contributions_and_base_add_up_to_the_prediction(rows):
    model = L.boosted_offsets(rows.filter("site < 400"), ["a", "b", "c"], ["T3_offset"], maxIter=12, maxDepth=4, stepSize=0.2)
    gone = rows.withColumn("b", F.when(F.col("site") != 7, F.col("b")))
    made = B.boosted_contributions(model, "T3_offset", rows.filter("site < 400"), gone, ["region", "site"])
    both = made.join(model.transform(rows), ["region", "site"]).select(made["a"], made["b"], made["c"], "base", "predicted_T3_offset").toPandas()
    assert len(both) == 599  # one row lacks a feature
    assert np.abs(both[["a", "b", "c", "base"]].sum(axis=1) - both["predicted_T3_offset"]).max() < 1e-9
    rank = [r.feature for r in L.attribution_rank(made.select("a", "b", "c")).collect()]
    assert rank[0] == "a" and rank[-1] == "c"


def test_expectations_are_means_over_the_given_rows(spark, rows):
    trees = spark.createDataFrame([(0, 2.0, 0, 0, 0.0, 1, 2, 9.0), (0, 2.0, 1, -1, None, -1, -1, 1.0), (0, 2.0, 2, 1, 5.0, 3, 4, 7.0), (0, 2.0, 3, -1, None, -1, -1, 4.0), (0, 2.0, 4, -1, None, -1, -1, 6.0), (1, 1.0, 0, -1, None, -1, -1, 3.0)], "tree int, weight double, node int, feature int, threshold double, left int, right int, value double")
    some = rows.filter("a <= 0")
    expected = {(r.tree, r.node): r.value for r in B.with_expectations(some, ["a", "b"], trees, 2).collect()}
    assert expected == {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 7.0, (0, 3): 4.0, (0, 4): 6.0, (1, 0): 3.0}  # no row passes node 2
    out = B.tree_contributions(rows, ["site"], ["a", "b"], B.with_expectations(rows, ["a", "b"], trees, 2), 2, 1.0).join(rows.select("site", F.col("a").alias("v")), "site").toPandas()
    share = (out["v"] <= 0).mean()
    root = share * 1 + (1 - share) * 4
    assert np.allclose(out["base"], 1 + 2 * root + 3) and np.allclose(out["a"], 2 * (np.where(out["v"] <= 0, 1, 4) - root)) and np.allclose(out["b"], 0)
    assert B.tree_contributions(rows.limit(0), ["site"], ["a", "b"], trees, 2).count() == 0


def test_leaves_are_counted_alike_by_the_model_and_by_its_table(rows):
    model = L.boosted_offsets(rows, ["a", "b", "c"], ["T3_offset"], maxIter=5, maxDepth=4, stepSize=0.2)
    stages = model.stages["T3_offset"]
    trees, depth = B.saved_trees(stages.stages[-1], rows)
    gone = rows.withColumn("b", F.when(F.col("site") != 7, F.col("b")))
    one, other = (sorted(map(tuple, c.select("tree", "leaf", "n").collect())) for c in (B.fitted_counts(stages, gone, trees), B.leaf_counts(gone, model.features, trees, depth)))
    assert one == other and sum(n for t, _, n in one if t == 0) == 599
    assert not stages.stages[-1].getLeafCol()


def test_rows_of_a_fit_are_dealt_by_their_number(spark, monkeypatch):
    """A file of many rows is one task; its fit must not be."""
    monkeypatch.setattr(L, "TASK_ROWS", 100)
    df = spark.range(2000).coalesce(1).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("y"))
    fits, fit = [], L.GBTRegressor.fit
    monkeypatch.setattr(L.GBTRegressor, "fit", lambda self, d: fits.append(d.groupBy(F.spark_partition_id()).count().collect()) or fit(self, d))
    L.boosted_offsets(df, ["a"], ["y"], maxIter=1, maxDepth=2)
    assert max(r["count"] for r in fits[0]) <= 150

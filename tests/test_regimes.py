import numpy as np
from pyspark.sql import functions as F

from nivalis.plans import regimes as G


def test_regimes_separate_and_small_regions_are_left_out(spark):
    rows = [("R", float(k % 2) * 10 + k / 1000, float(k % 2)) for k in range(200)] + [("S", 0.0, 0.0)] * 5
    found = G.cluster_regimes(spark.createDataFrame(rows, "region string, u double, v double"), ["u", "v"], 2, 100)
    groups = {(r.region, r.v, r.cluster) for r in found.select("region", "v", "cluster").distinct().collect()}
    assert len(groups) == 2 and {g[0] for g in groups} == {"R"}


def test_rows_lie_with_the_nearest_mean_and_null_groups_and_constant_columns_are_clustered(spark):
    rng = np.random.default_rng(2)
    rows = [(g, *map(float, rng.normal(3 * (k % 3), 1, 2)), 7.0) for g in ("R", "S", None) for k in range(150)]
    rows += [("one", 1.0, 1.0, 1.0)] * 120 + [("gap", None, 1.0, 1.0)] * 120
    df = spark.createDataFrame(rows, "region string, u double, v double, w double")
    found = G.cluster_regimes(df, ["u", "v", "w"], 3).toPandas()
    assert len(found) == 570 and set(found[found["region"] == "one"]["cluster"]) == {0}
    for g in ("R", "S", None):
        own = found[found["region"].isna() if g is None else found["region"] == g]
        z = own[["u", "v"]].to_numpy()
        z = (z - z.mean(0)) / z.std(0, ddof=1)
        centres = np.array([z[own["cluster"] == c].mean(0) for c in range(3)])
        d = ((z[:, None] - centres) ** 2).sum(2)
        assert np.all(d[np.arange(len(z)), own["cluster"]] <= d.min(1) + 1e-2)
        assert d.min(1).sum() < 0.35 * (z**2).sum()


def jobs_of(spark, run):
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    run()
    return scheduler.numTotalJobs() - before


def test_jobs_do_not_follow_the_number_of_regions(spark):
    def clustered(regions):
        df = spark.range(regions * 40).select((F.col("id") % regions).alias("region"), ((F.floor(F.col("id") / regions) % 2) * 10 + F.rand(1)).alias("u"), F.rand(2).alias("v"))
        out = G.cluster_regimes(df, ["u", "v"], 2, 40).groupBy("region").agg(F.count_distinct("cluster").alias("n"), F.count("*").alias("rows"))
        return out.filter("n = 2 and rows = 40").count()

    found = {}
    few, many = (jobs_of(spark, lambda n=n: found.update({n: clustered(n)})) for n in (3, 1000))
    assert found == {3: 3, 1000: 1000} and many <= 3 * few < 400


def test_groups_go_on_until_each_row_lies_with_the_mean_of_its_own(spark):
    """A dense square of rows moves its border for more than 20 rounds."""
    rng = np.random.default_rng(5)
    rows = [(g, *map(float, rng.uniform(size=2))) for g in range(40) for _ in range(300)]
    df = spark.createDataFrame(rows, "site int, u double, v double")
    found = G.cluster_regimes(df, ["u", "v"], 2, 30, by="site", rounds=None, tolerance=1e-9).toPandas()
    for g, own in found.groupby("site"):
        z = own[["u", "v"]].to_numpy()
        z = (z - z.mean(0)) / z.std(0, ddof=1)
        d = ((z[:, None] - np.array([z[own["cluster"] == c].mean(0) for c in range(2)])) ** 2).sum(2)
        assert len(own) == 300 and np.all(d[np.arange(len(z)), own["cluster"]] <= d.min(1) + 1e-9)

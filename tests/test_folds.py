import numpy as np
import pytest
from pyspark.sql import functions as F

from nivalis.plans import folds as S
from nivalis.plans import modelling as L

FEATURES = ["a", "b", "skt"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = []
    for region in ("R/1", "S"):
        for year in (2020, 2021):
            for k in range(60):
                a, b, skt = rng.uniform(-1, 1), rng.uniform(0, 5), 270 + rng.normal(0, 5)
                off = 3 * (a > 0) - 0.8 * b + rng.normal(0, 0.3)
                rows.append((region, k, f"{year}-01-10 00:00:00", a, b, skt, skt - 273.15 + off, off))
    rows += [("T", 1, "2030-01-01 00:00:00", 0.0, 0.0, 270.0, 1.0, None)]  # nothing to judge by
    df = spark.createDataFrame(rows, "region string, site int, t string, a double, b double, skt double, T3 double, T3_offset double")
    path = str(tmp_path_factory.mktemp("table") / "t")
    df.withColumn("time", F.to_timestamp("t")).drop("t").write.parquet(path)
    return spark.read.parquet(path)


def fitters(calls):
    def boosted(train):
        calls.append(sorted({(r.region, r.y) for r in train.select("region", F.year("time").alias("y")).distinct().collect()}))
        return L.boosted_offsets(train, FEATURES, ["T3_offset"], maxIter=4, maxDepth=3, stepSize=0.5)

    return {"boosted": boosted, "lasso": lambda train: L.bagged_lasso(train, FEATURES, ["region", "site", "time"], ["T3_offset"], bags=2, feature_share=1.0)}


def test_all_folds_are_fitted_judged_and_not_fitted_again(spark, table, tmp_path):
    folder, calls = str(tmp_path / "folds"), []
    known = S.fit_folds(table, FEATURES, "T3", folder, fitters(calls))
    rows = known.orderBy("region", "model_year", "kind").collect()
    assert [(r.region, r.model_year, r.kind) for r in rows] == [(g, y, k) for g in ("R/1", "S") for y in (2020, 2021) for k in ("boosted", "lasso")]
    assert all(r.n == 60 and r.n_train == 60 and r.features == FEATURES for r in rows)
    assert all(r.rmse_fit < r.rmse_raw and r.corr_fit > r.corr_raw for r in rows)
    assert sorted(calls) == sorted([[("S", 2021)], [("S", 2020)], [("R/1", 2021)], [("R/1", 2020)]])
    made = S.predictions(spark, folder)
    assert made.count() == 240 and {"boosted_T3", "lasso_T3"} <= set(made.columns)
    # a fold whose entry is missing is fitted again, others are not
    path, files = S._path(spark, f"{folder}/registry/fold=S-2020")
    files.delete(path, True)
    again = []
    assert S.fit_folds(table, FEATURES, "T3", folder, fitters(again)).count() == 8
    assert again == [[("R/1", 2021)]]
    # models come back from the registry; a year without one gets one of the region's
    wanted = spark.createDataFrame([("S", 2020), ("S", 1999), ("Q", 2020)], "region string, year int")
    models = S.models_for(S.registry(spark, folder), wanted, "boosted")
    assert set(models) == {("S", 2020), ("S", 1999)}
    rest = table.filter("region = 'S' and year(time) = 2020")
    own = S.predict_with(models, rest).join(S.predictions(spark, folder), ["region", "site", "time"]).agg(F.max(F.abs(F.col("predicted_T3") - F.col("boosted_T3")))).first()[0]
    assert own < 1e-9


def test_an_empty_registry(spark, table, tmp_path):
    assert S.registry(spark, str(tmp_path / "none")).count() == 0
    assert S.folds_of(table.filter("region = 'S' and year(time) = 2020"), ["T3_offset"]) == []


def test_a_fold_reads_no_files_of_other_folds(spark, table, tmp_path):
    """Each file that a fold learns from holds rows it learns from only, so its time does not grow by those of others."""
    seen = []

    def boosted(train):
        files = [r[0] for r in train.select(F.input_file_name()).distinct().collect()]
        seen.append((spark.read.parquet(*files).count(), train.count()))
        return L.boosted_offsets(train, FEATURES, ["T3_offset"], maxIter=2, maxDepth=2)

    known = S.fit_folds(L.put_together(table, FEATURES), FEATURES, "T3", str(tmp_path / "folds"), {"boosted": boosted})
    assert seen == [(60, 60)] * 4 and {r.n_train for r in known.collect()} == {60}


def test_rows_without_a_feature_count_but_are_not_fitted(spark, table):
    rows = [(1.0, 2.0, 0.5), (None, 2.0, 0.5), (float("nan"), 2.0, 0.5), (1.0, 0.0, None)]
    made = L.put_together(spark.createDataFrame(rows, "a double, b double, T3_offset double"), ["a", "b"])
    assert [r._vector is None for r in made.orderBy(F.col("T3_offset").isNull(), F.col("_vector").isNull()).collect()] == [False, True, True, False]
    gap = table.filter("T3_offset is not null").withColumn("a", F.when(F.col("site") > 5, F.col("a")))
    plain, put = (L.boosted_offsets(x, FEATURES, ["T3_offset"], maxIter=2, maxDepth=2, subsamplingRate=1.0) for x in (gap, L.put_together(gap, FEATURES)))
    assert plain.start == put.start
    assert plain.transform(gap).exceptAll(put.transform(gap)).count() == 0


def test_large_folds_are_fitted_one_by_one(spark):
    assert S._side_by_side(spark, [1000, 10], 3) == 3 and S._side_by_side(spark, [10**12], 4) == 1


def test_predictions_are_judged_without_a_join_and_written_by_the_tasks_that_made_them(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "held_out_skill", lambda *a, **b: pytest.fail("predictions are joined to their rows"))
    monkeypatch.setattr(S, "held_out_skill", L.held_out_skill, raising=False)
    lay = S._laid
    monkeypatch.setattr(S, "_laid", lambda *a: (lambda laid, numbers: (laid.repartition(4, "site"), numbers))(*lay(*a)))
    folder = str(tmp_path / "folds")
    twice = table.filter("region = 'S' and site < 5")  # equal keys are rows of their own
    known = S.fit_folds(table.unionByName(twice), FEATURES, "T3", folder, {"boosted": lambda train: L.boosted_offsets(train, FEATURES, ["T3_offset"], maxIter=2, maxDepth=2)})
    assert {(r.region, r.model_year): r.n for r in known.collect()} == {("R/1", 2020): 60, ("R/1", 2021): 60, ("S", 2020): 65, ("S", 2021): 65}
    files = list((tmp_path / "folds" / "predictions" / "S-2020").glob("part-*.parquet"))
    assert len(files) > 1 and S.predictions(spark, folder).count() == 250
    own = S.predictions(spark, folder).dropDuplicates(["region", "site", "time"]).join(table, ["region", "site", "time"]).filter("region = 'R/1' and year(time) = 2020")
    rmse = own.agg(F.sqrt(F.avg(F.pow(F.col("boosted_T3") - F.col("T3"), 2)))).first()[0]
    assert known.filter("region = 'R/1' and model_year = 2020").first().rmse_fit == pytest.approx(rmse)

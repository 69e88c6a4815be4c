import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivalis.functions import skill as M
from nivalis.functions.timecols import day_of_year
from nivalis.operators import aggregate as A
from nivalis.operators import bioclim as B
from nivalis.operators import select as P
from nivalis.operators import series as S
from nivalis.plans import catalog, registry
from nivalis.sources import adapters, io
from nivalis.tables import size_of

H = dt.datetime(2024, 1, 1)


def series(spark, values, site="a"):
    rows = [(site, H + dt.timedelta(hours=k), v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, time timestamp, v double")


def one(df, col):
    return df.first()[col]


def test_nulls_break_episodes_but_not_freeze_thaw(spark):
    df = series(spark, [-1.0, None, -1.0, 3.0, 1.0, 1.0, None, 5.0])
    assert one(B.freeze_thaw_cycles(df, "v", ["site"]), "freeze_thaw") == 1
    row = B.episodes_within(df, "v", ["site"], -2, 2).first()
    assert (row.episodes, row.episode_length) == (3, 4 / 3)
    assert one(B.freeze_thaw_cycles(series(spark, [1.0, None]), "v", ["site"]), "freeze_thaw") is None
    single = B.episodes_within(series(spark, [1.0, 9.0]), "v", ["site"], -2, 2).first()
    assert (single.episodes, single.episode_length) == (None, 1.0)
    assert one(B.degree_hours(series(spark, [None, None]), "v", ["site"]), "degree_hours") == 0.0


def test_leap_day_of_year(spark):
    days = [(dt.datetime(y, m, d),) for y, m, d in ((2000, 2, 28), (2000, 2, 29), (2000, 3, 1), (2000, 12, 31), (2001, 3, 1), (1900, 3, 1))]
    got = [r[0] for r in spark.createDataFrame(days, "t timestamp").select(day_of_year("t")).collect()]
    assert got == [59, None, 60, 365, 60, 60]


def test_constant_series_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "o double, m double")
    row = df.agg(M.pearson("o", "m").alias("r"), M.r2_score("o", "m").alias("s"), M.bias("o", "m").alias("b")).first()
    assert (row.r, row.s, row.b) == (None, None, 1.5)


def test_event_scores_without_denominator_are_null(spark):
    df = spark.createDataFrame([(5.0, 6.0), (4.0, None)], "o double, m double")
    row = M.event_skill(df, "o", ["m"]).first()
    assert (row.tn, row.precision, row.recall, row.tnr) == (1, None, None, 1.0)


def test_lags_by_row_and_by_time(spark):
    df = series(spark, [1.0, 2.0, 3.0]).filter("v != 2.0")
    by_row = {r.v: r["v_-001"] for r in S.lag_features(df, ["v"], ["site"], [1]).collect()}
    by_time = {r.v: r["v_-002"] for r in S.lag_features(df, ["v"], ["site"], [2], by_time=True).collect()}
    assert by_row == {1.0: None, 3.0: 1.0} and by_time == {1.0: None, 3.0: 1.0}


def test_gap_fill_stays_within_a_site(spark):
    df = series(spark, [None, 2.0, None]).unionByName(series(spark, [None, None], "b"))
    got = {(r.site, r.time.hour): r.v for r in S.fill_gaps(df, ["v"], ["site"], ["time"]).collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 2.0, ("a", 2): 2.0, ("b", 0): 0.0, ("b", 1): 0.0}


def test_smoothing_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    v = [None if k % 7 == 3 else float(x) for k, x in enumerate(rng.standard_normal(40))]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(v)], "site string, doy int, v double")
    got = {r.doy: r.v_smooth for r in S.gaussian_smooth_1d(df, "v", ["site"], "doy", 3.0).collect()}
    for i in range(40):
        w = [(math.exp(-0.5 * (k / 3) ** 2), v[(i + k) % 40]) for k in range(-12, 13)]
        assert abs(got[i] - sum(a * b for a, b in w if b is not None) / sum(a for a, b in w if b is not None)) < 1e-9


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (5.0,), (11.0,)], "v double")
    assert [r.n for r in A.histogram(df, "v", 5, 0.0, 10.0).orderBy("bin").collect()] == [1, 0, 1, 0, 1]


def test_within_day_argument_is_checked(spark):
    with pytest.raises(ValueError):
        A.spatial_range_daily(series(spark, [1.0]), ["v"], "site", "median")


def test_kept_points_are_apart_and_dropped_ones_close(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 100, (150, 2)))]
    kept = {r.site for r in P.min_distance_sample(spark.createDataFrame(rows, "site int, x double, y double"), 12.0).collect()}
    at = {k: np.array((x, y)) for k, x, y in rows}
    near = lambda a, b: np.hypot(*(at[a] - at[b])) < 12.0
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(any(near(a, b) for b in kept) for a in at if a not in kept)


def test_files_that_are_missing_are_skipped(spark, tmp_path):
    io.write_table(series(spark, [1.0, 2.0]), f"{tmp_path}/a")
    io.write_table(series(spark, [3.0]).withColumn("w", F.lit(1)), f"{tmp_path}/b")
    out = io.read_many(spark, [f"{tmp_path}/a", f"{tmp_path}/none", f"{tmp_path}/b"])
    assert out.count() == 3 and out.filter("w is null").count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_many(spark, [f"{tmp_path}/a", f"{tmp_path}/none"], on_missing="fail")


def test_csv_readings_round_trip(spark, tmp_path):
    names = "region,site,tomst_id,datetime,T1,T2,T3,lon,lat,x,y"
    (tmp_path / "r.csv").write_text(f"{names}\nKIL,s1,5,2024-01-01 03:00:00,1.5,,2.5,21.0,68.0,1,2\n")
    row = io.read_readings(spark, str(tmp_path / "r.csv")).first()
    assert row.time == dt.datetime(2024, 1, 1, 3) and row.T2 is None and row.T1 == 1.5


def test_season_and_padded_month(spark):
    t = spark.createDataFrame([(dt.datetime(2024, m, 1),) for m in (1, 4, 7, 10, 12)], "time timestamp")
    assert [r[0] for r in t.select(A.season()).collect()] == ["DJF", "MAM", "JJA", "SON", "DJF"]
    hours = [r.time for r in P.padded_month_range(spark, 2024, 2).collect()]
    assert len(hours) == 29 * 24 + 8 and min(hours) == dt.datetime(2024, 1, 31, 20)


def test_rounding_is_no_warmer_model_and_regions_do_not_mix(spark, monkeypatch):
    rows = [("R", 1, H, 0.3, 0.1 + 0.2), ("R", 2, H, 1.0, 1.5), ("S", 2, H, 2.0, 2.5)]  # 0.1 + 0.2 > 0.3 by rounding
    df = spark.createDataFrame(rows, "region string, site long, time timestamp, T3 double, gbt_T3 double")
    monkeypatch.setattr(registry, "table", lambda *a: df)
    found = sorted((r.site, r.T3, r.m) for r in catalog.queries()["j02_attach_model"](spark, "").collect())
    assert found == [(1, 0.3, None), (2, 1.0, 1.5), (2, 2.0, 2.5)]


def test_both_variograms_come_from_one_table_of_pairs(spark, monkeypatch):
    rows = [("R", k, H, 600.0 * k, 0.0, float(k), 2.0 * k) for k in range(3)] + [("R", 3, H, 0.0, 100.0, None, 1.0)]
    df, asked = spark.createDataFrame(rows, "region string, site long, time timestamp, x double, y double, T3 double, gbt_T3 double"), []
    monkeypatch.setattr(registry, "table", lambda s, d, n: asked.append(n) or df)
    found = {r.bin: r for r in catalog.queries()["j04_attach_obs_variogram"](spark, "").collect()}
    assert asked == ["skill"] and len(found) == 20
    assert (found[1].err_count, found[1].gamma_err, found[1].gamma_obs) == (2, 0.5, 0.5) and found[2].obs_count == 1 and found[0].gamma_obs is None


def test_skill_table_is_dealt_by_the_size_of_the_lines_and_keeps_its_rows(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(adapters, "_SHARE", 10_000)
    found = adapters.table(spark, folder, "skill")
    assert found.rdd.getNumPartitions() == size_of(spark, f"{folder}/lineitem.parquet") // 10_000 > 4
    parts = {b: adapters.table(spark, folder, b) for b in ("lineitem", "sites")}
    plain = spark.sql(adapters.TEXTS["skill"], **parts)
    rounded = lambda df: df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    assert found.columns == plain.columns
    assert rounded(found).exceptAll(rounded(plain)).isEmpty() and rounded(plain).exceptAll(rounded(found)).isEmpty()

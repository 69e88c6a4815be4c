"""What keeps plans sound on large tables, and cases that the reference SQL does not reach."""

import numpy as np
from pyspark.sql import functions as F

from nivalis.functions import physics as D
from nivalis.functions import skill as M
from nivalis.operators import aggregate as A
from nivalis.operators import bioclim as B
from nivalis.operators import interpolate as I
from nivalis.operators import pairs as V
from nivalis.operators import ranges
from nivalis.operators import terrain as T
from nivalis.sources import io


def joins(df):
    return df._jdf.queryExecution().analyzed().toString().count("Join ")


def test_terrain_plans_do_not_double_by_statistic(spark):
    rows = [("R", i, j, -10.0 * i, 10.0 * j, float(i * j % 7), 0.1 * i, 1.0 * j, 0.5, 2.0 * i) for i in range(4) for j in range(5)]
    df = spark.createDataFrame(rows, "region string, iy int, ix int, y double, x double, dem10m double, svf double, mbi double, norm_height double, windexp500 double")
    assert joins(T.cold_air_pooling(df)) == 2 and joins(T.cold_bias(df)) == 3 and joins(T.wind_exposure(df)) == 1
    assert joins(T.static_predictors(df, (3, 5))) < 30
    both = T.static_predictors(df, (3, 5))
    assert {"tri_w3", "tri_w5", "openness_proxy_w3", "openness_proxy_w5", "capi", "cold_bias_potential"} <= set(both.columns) and both.count() == 20


def test_scores_without_a_denominator(spark):
    rows = [("none", 1.0, 1.0), ("missed", -1.0, 1.0), ("false", 1.0, -1.0), ("apart", -1.0, 1.0), ("apart", 1.0, -1.0), ("hit", -1.0, -1.0), ("hit", -1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, o double, m double")
    got = {r.g: (r.precision, r.recall, r.f1) for r in M.event_skill(df, "o", ["m"], 0.0, ["g"]).collect()}
    assert got == {"none": (None, None, None), "missed": (None, 0.0, None), "false": (0.0, None, None), "apart": (0.0, 0.0, None), "hit": (1.0, 0.5, 2 / 3)}


def test_indicators_agree_with_the_single_ones_and_keep_null_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(g, s, f"2020-0{1 + k % 3}-0{1 + k % 5} 0{k % 10}:00:00", None if k % 11 == 4 else float(rng.normal(0, 3))) for g in ("R", None) for s in (1, None) for k in range(90)]
    df = spark.createDataFrame(rows, "region string, site int, t string, v double").withColumn("time", F.to_timestamp("t")).dropDuplicates(["region", "site", "time"])
    by = ["region", "site"]
    every = {(r.region, r.site): r.asDict() for r in B.indicators(df, "v", by).collect()}
    assert set(every) == {("R", 1), ("R", None), (None, 1), (None, None)}
    for made in (B.frost_hours(df, "v", by), B.degree_hours(df, "v", by), B.freeze_thaw_cycles(df, "v", by), B.episodes_within(df, "v", by, -2.0, 2.0), B.diurnal_amplitude(df, "v", by), B.warmth_and_coldness(df, "v", by)):
        for r in made.collect():
            for name, x in r.asDict().items():
                y = every[r.region, r.site][name]
                assert (x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-9), name
    summary = B.bioclim_summary(df.withColumn("m", F.col("v") + 1), "v", ["m"])
    assert joins(summary) == 0
    biases = {r.mean_temp_bias for r in summary.filter("series = 'm'").collect()}
    assert len(summary.collect()) == 8 and all(abs(b - 1) < 1e-9 for b in biases)


def test_ranks_quantiles_and_running_minima_range_by_range(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 2 else f"g{g}", float(v) if v < 45 else None) for g in range(3) for v in rng.integers(0, 50, 300)]
    df = spark.createDataFrame(rows, "g string, v double")
    for g in ("g0", "g1", None):
        own = np.array([v for k, v in rows if k == g and v is not None])
        got = [r for r in M.average_rank(df.dropna(subset=["v"]), "v", ["g"], "rank").collect() if r.g == g]
        assert all(r["rank"] == (own < r.v).sum() + ((own == r.v).sum() + 1) / 2 for r in got) and len(got) == len(own)
        q = [r for r in A.box_stats(df, ["g"], "v").collect() if r.g == g][0]
        assert (q.n, q.q1, q.median, q.q3) == (len(own), *np.percentile(own, [25, 50, 75]))
    trials = spark.createDataFrame([(int(k), float(v)) for k, v in enumerate(rng.permutation(500))], "number long, value double")
    best, so_far = A.trial_summary(trials)
    values = [r.value for r in trials.orderBy("number").collect()]
    assert [r.best_so_far for r in so_far.orderBy("number").collect()] == list(np.minimum.accumulate(values))
    assert best.first().number == int(np.argmin(values))
    assert "SinglePartition" not in ranges.with_piece(trials, "number")._jdf.queryExecution().executedPlan().toString()


def test_pairs_on_the_great_circle(spark):
    rows = [(k, "2020-01-01 00:00:00", 20.0 + 0.05 * k, 68.0 + 0.03 * (k % 4), float(k * k % 7)) for k in range(30)]
    df = spark.createDataFrame(rows, "site int, t string, lon double, lat double, v double").withColumn("time", F.to_timestamp("t"))
    got = V.same_hour_pairs(df, "v", 8000.0, prefer_xy=False).select("site", "k2", "distance").collect()
    far = lambda a, b: 2 * 6371000 * np.arcsin(np.sqrt(np.sin(np.radians(b[3] - a[3]) / 2) ** 2 + np.cos(np.radians(a[3])) * np.cos(np.radians(b[3])) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2))
    want = {(a[0], b[0]): far(a, b) for a in rows for b in rows if a[0] < b[0] and far(a, b) < 8000}
    assert {(r.site, r.k2) for r in got} == set(want) and all(abs(r.distance - want[r.site, r.k2]) < 1e-3 for r in got)
    assert D.EARTH_RADIUS == 6371000.0


def test_both_variograms_from_one_table_of_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(s, f"2020-01-01 0{h}:00:00", *map(float, rng.uniform(0, 20000, 2)), float(rng.normal()), None if s % 6 == 2 else float(rng.normal())) for h in range(3) for s in range(40)]
    df = spark.createDataFrame(rows, "site int, t string, x double, y double, o double, m double").withColumn("time", F.to_timestamp("t"))
    apart = V.attach_obs_variogram(V.semivariogram(df, "o", "m"), V.field_variogram(df, "o"))
    columns = ["bin", "lag", "err_count", "obs_count", F.round("gamma_err", 9), F.round("gamma_obs", 9)]
    once = V.error_and_obs_variograms(df, "o", "m")
    assert sorted(map(tuple, apart.select(*columns).collect())) == sorted(map(tuple, once.select(*columns).collect()))


def test_irregular_axes(spark):
    ys, xs = [0.0, 1.0, 4.0, 4.5, 11.0], [-3.0, 0.0, 0.25, 9.0]
    grid = spark.createDataFrame([(y, x, 2 * y - 3 * x + 1) for y in ys for x in xs], "lat double, lon double, v double")
    rng = np.random.default_rng(3)
    at = [(k, float(rng.uniform(0, 11)), float(rng.uniform(-3, 9))) for k in range(50)] + [(50, 0.0, -3.0), (51, 11.0, 9.0), (52, 4.25, 0.125), (53, 11.5, 0.0), (54, -1.0, 10.0)]
    points = spark.createDataFrame(at, "site int, lat double, lon double")
    near = {r.site: (r.cell_lat, r.cell_lon) for r in I.nearest_cell(points, grid).collect()}
    line = {r.site: r.v for r in I.interp_bilinear(points, grid, "v", cols=("lat", "lon")).collect()}
    for k, y, x in at:
        assert near[k] == (min(ys, key=lambda c: (abs(c - y), c)), min(xs, key=lambda c: (abs(c - x), c)))
        inside = 0 <= y <= 11 and -3 <= x <= 9
        assert (line[k] is not None) == inside and (not inside or abs(line[k] - (2 * y - 3 * x + 1)) < 1e-9)


def test_times_are_bracketed_range_by_range(spark):
    rng = np.random.default_rng(5)
    known, wanted = sorted(map(int, rng.choice(5000, 60, False))), sorted(map(int, rng.choice(6000, 300, False)))
    frame = lambda t: spark.createDataFrame([(k,) for k in t], "s int").select(F.timestamp_seconds(F.col("s") * 60).alias("time"))
    for pieces in (1, 7, 64):
        out = I.bracket_times(frame(wanted), frame(known), pieces=pieces)
        got = {r.t: (r.a, r.b, r.wt) for r in out.select(*((F.unix_timestamp(c) / 60).cast("int").alias(n) for c, n in (("time", "t"), ("t0", "a"), ("t1", "b"))), "wt").collect()}
        assert set(got) == set(known) | set(wanted)
        for t, (a, b, w) in got.items():
            before, after = max((k for k in known if k <= t), default=None), min((k for k in known if k >= t), default=None)
            assert (a, b) == (before, after)
            assert w is None if None in (a, b) else abs(w - (0 if a == b else (t - a) / (b - a))) < 1e-9
    assert "_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_near_the_pole_and_across_the_date_line(spark):
    rng = np.random.default_rng(6)
    rows = [(k, "2020-01-01 00:00:00", float((179.9 + d) % 360 - 360 * (((179.9 + d) % 360) > 180)), float(lat), 1.0) for k, (d, lat) in enumerate(zip(rng.uniform(0, 0.3, 60), rng.uniform(-1, 1, 60) * 0.1, strict=True))]
    rows += [(100 + k, "2020-01-01 00:00:00", float(lon), float(lat), 2.0) for k, (lon, lat) in enumerate(zip(rng.uniform(-180, 180, 120), rng.uniform(84.5, 90, 120), strict=True))]
    rows += [(300, "2020-01-01 00:00:00", 10.0, 90.0, 1.0), (301, "2020-01-01 00:00:00", -170.0, 90.0, 1.0), (302, "2020-01-01 00:00:00", 0.0, -90.0, 1.0)]
    df = spark.createDataFrame(rows, "site int, t string, lon double, lat double, v double").withColumn("time", F.to_timestamp("t"))

    def far(a, b):
        h = np.sin(np.radians(b[3] - a[3]) / 2) ** 2 + np.cos(np.radians(a[3])) * np.cos(np.radians(b[3])) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * np.arcsin(np.sqrt(h))

    for limit in (10_000.0, 120_000.0, 3e7):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and far(a, b) < limit}
        found = [(r.site, r.k2) for r in V.same_hour_pairs(df, "v", limit, prefer_xy=False).collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 30


def test_a_long_chain_is_thinned_to_its_end(spark):
    from nivalis.operators import select as P

    n = 400  # every point is close to the next only
    df = spark.range(n).select(F.col("id").cast("int").alias("site"), (F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    kept = sorted(r.x for r in P.min_distance_sample(df, 15.0).collect())
    gaps = np.diff([-20.0, *kept, n * 10.0 + 10])
    assert gaps[1:-1].min() >= 15 and gaps.max() <= 30  # none too close, none left undecided


def test_medians_are_the_same_in_one_aggregate_and_range_by_range(spark):
    rng = np.random.default_rng(11)
    rows = [(f"2020-01-0{1 + k % 3} 00:00:00", int(c), None if rng.uniform() < 0.1 else float(rng.integers(0, 40))) for k in range(3) for c in range(200 - 80 * k)]
    df = spark.createDataFrame(rows, "t string, cell int, v double").withColumn("time", F.to_timestamp("t"))
    assert ranges.LARGE >= 100_000
    want = sorted(map(tuple, df.groupBy("time").agg(F.median("v")).collect()))
    for large in (0, 100, 10_000):
        assert sorted(map(tuple, ranges.medians(df, "v", ["time"], "m", large).collect())) == want
    maps = [sorted(map(tuple, A.median_anomaly_map(df, "v", ["cell"], large=n).collect()), key=str) for n in (1, 100, 10_000)]
    assert maps[0] == maps[1] == maps[2] and len(maps[0]) == 200


def test_medians_of_large_groups_are_exact(spark):
    df = spark.range(300_000).select((F.col("id") % 10 == 0).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(2, None), (None, 5.0), (3, 1.0)], "g int, v double"))
    out = A.top_groups(df, "g", "v", 3)
    own = df.toPandas()
    got = {r.g: (r["count"], r.median) for r in out.collect()}
    assert got == {0: (270_000, own[own["g"] == 0]["v"].median()), 1: (30_000, own[own["g"] == 1]["v"].median()), None: (1, 5.0)}


def test_overwriting_a_partition_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.createDataFrame([("R", 1), ("S", 2)], "region string, v int"), path, ["region"])
    io.write_table(spark.createDataFrame([("S", 3)], "region string, v int"), path, ["region"])
    assert {(r.region, r.v) for r in spark.read.parquet(path).collect()} == {("R", 1), ("S", 3)}


def test_sampled_variogram_with_room_for_all_pairs_is_the_whole_one(spark):
    rng = np.random.default_rng(9)
    rows = [(s, f"2020-01-01 0{h}:00:00", *map(float, rng.uniform(0, 20000, 2)), float(rng.normal()), float(rng.normal())) for h in range(4) for s in range(30)]
    df = spark.createDataFrame(rows, "site int, t string, x double, y double, o double, m double").withColumn("time", F.to_timestamp("t"))
    rounded = ["bin", "n_pairs", F.round("gamma", 9)]
    whole, every = V.semivariogram(df, "o", "m").select(*rounded), V.sampled_semivariogram(df, "o", "m", n_hours=4, pairs_per_hour=5000).select(*rounded)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, every.collect()))
    few = V.sampled_semivariogram(df, "o", "m", n_hours=2, pairs_per_hour=10)
    assert few.agg(F.sum("n_pairs")).first()[0] == 20 and sorted(map(tuple, few.collect())) == sorted(map(tuple, V.sampled_semivariogram(df, "o", "m", n_hours=2, pairs_per_hour=10).collect()))


def test_pairs_of_sites_are_dealt_over_tasks(spark):
    from nivalis.plans import q_skill

    sites = spark.createDataFrame([(s, "A" if s % 3 else "B", 1.0 * s, 2.0 * s, 3.0 * s, 4.0 * s) for s in range(60)], "site int, region string, lon double, lat double, x double, y double").coalesce(1)
    pairs = q_skill._pairs(lambda _: sites)
    sizes = [n for n in pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= 4 and sum(sizes) == 40 * 39 // 2 + 20 * 19 // 2


def test_pairs_of_sites_are_dealt_by_two_ranges_of_sites(spark, monkeypatch):
    from nivalis.plans import q_skill

    monkeypatch.setattr(q_skill, "_RANGE", 4, raising=False)
    rows = [(k, "AB"[k % 7 == 0], 10.0 + k, 60.0, 100.0 * k, 0.0) for k in range(0, 120, 2)] + [(None, "A", 1.0, 1.0, 1.0, 1.0), (9, None, 1.0, 1.0, 1.0, 1.0)]
    sites = spark.createDataFrame(rows, "site long, region string, lon double, lat double, x double, y double")
    made = q_skill._pairs(lambda name: sites)
    found = sorted((r.s1, r.s2, r.x1, r.x2) for r in made.collect())
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    assert found == sorted((a[0], b[0], a[4], b[4]) for a in known for b in known if a[1] == b[1] and a[0] < b[0])
    sizes = [r["count"] for r in made.withColumn("p", F.spark_partition_id()).groupBy("p", "s1").count().collect()]
    assert max(sizes) <= 8  # a site meets no more than a range or two of its region in a task, not all 51

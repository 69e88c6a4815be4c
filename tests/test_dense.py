import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from nivalis.plans import dense as D
from nivalis.plans import modelling as L

KEYS = ["region", "iy", "ix", "time"]


class Plane:
    """Predicts a known function of its rows."""

    def transform(self, df):
        return df.withColumn("predicted_skt_offset", F.col("skt_+000") * 0.1 + F.col("skt_-003").isNull().cast("int") + F.col("dem10m"))


@pytest.fixture(scope="module")
def tables(spark):
    grid = [(r, i, j, -10.0 * i, 10.0 * j, 65.0 + i / 10, 20.0 + j / 10, None if (i, j) == (2, 2) else float(i + 2 * j)) for r, ny, nx in (("A", 12, 20), ("B", 5, 6)) for i in range(ny) for j in range(nx)]
    cube = [(f"2020-0{m}-0{d} 0{h}:00:00", float(y), float(x), 270.0 + y + 2 * x + h + m) for m in (1, 2, 3) for d in (1, 2) for h in range(3) for y in (65, 66, 67) for x in (20, 21, 22)]
    return (
        spark.createDataFrame(grid, "region string, iy int, ix int, y double, x double, lat double, lon double, dem10m double"),
        spark.createDataFrame(cube, "t string, lat double, lon double, skt double").withColumn("time", F.to_timestamp("t")).drop("t"),
        spark.createDataFrame([("A", 20.0, -30.0), ("A", 150.0, -80.0), ("B", 0.0, 0.0), ("B", 50.0, -40.0)], "region string, x double, y double"),
    )


def test_one_month_equals_a_loop(tables):
    grid, cube, points = tables
    out = L.predict_grid(Plane(), grid.filter("region = 'A'"), cube, points, 2020, 2, ["dem10m"], ["skt"], 30, 0.0, "skt_+000").toPandas()
    inside = [(i, j) for i in range(3, 9) for j in range(2, 16)]
    kept = [(i, j) for i, j in inside if (i - 3) % 2 == 0 and (j - 2) % 2 == 0]  # 3 x 7 of 6 x 14
    assert len(out) == len(kept) * 6 and {(r.iy, r.ix) for r in out.itertuples()} == set(kept)
    times = sorted(out["time"].unique())
    for r in out.itertuples():
        h = times.index(np.datetime64(r.time)) % 3
        lat, lon = 65 + r.iy / 10, 20 + r.ix / 10
        skt = 270 + lat + 2 * lon + h + 2
        lag = r.predicted_skt_offset - 0.1 * skt - (r.iy + 2 * r.ix)
        assert abs(lag) < 1e-6 or abs(lag - 1) < 1e-6
        assert abs(r.predicted_skt - (r.predicted_skt_offset + skt - 273.15)) < 1e-6


def test_all_months_equal_single_calls_and_a_box_reads_few_files(spark, tables, tmp_path):
    grid, cube, points = tables
    months = spark.createDataFrame([("A", 2020, 1), ("A", 2020, 3), ("B", 2020, 3), ("B", 2021, 1)], "region string, year int, month int")
    made = D.predict_months(Plane(), grid, cube, points, months, ["dem10m"], ["skt"], 60, 0.0, "skt_+000")
    columns = [*KEYS, F.round("predicted_skt_offset", 9), F.round("predicted_skt", 9)]
    want = None
    for region, month in (("A", 1), ("A", 3), ("B", 3)):
        one = L.predict_grid(Plane(), grid.filter(F.col("region") == region), cube, points, 2020, month, ["dem10m"], ["skt"], 60, 0.0, "skt_+000")
        want = one if want is None else want.unionByName(one)
    assert sorted(map(tuple, made.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    by_fold = D.predict_months({("A", 2020): Plane(), ("B", 2020): Plane()}, grid, cube, points, months, ["dem10m"], ["skt"], 60, 0.0, "skt_+000")
    assert sorted(map(tuple, by_fold.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_tiles_prune_a_box_and_leave_other_partitions(spark, tmp_path):
    path = str(tmp_path / "tiles")
    cells = spark.range(128 * 128).select(F.lit("A").alias("region"), F.floor(F.col("id") / 128).cast("int").alias("iy"), (F.col("id") % 128).cast("int").alias("ix"), F.col("id").alias("v"), F.lit(2020).alias("year"), F.lit(1).alias("month"))
    D.write_tiles(cells, path, cells_per_file=256)
    D.write_tiles(cells.withColumn("month", F.lit(2)).filter("iy < 4"), path, cells_per_file=256)
    assert spark.read.parquet(path).groupBy("month").count().orderBy("month").collect() == [(1, 128 * 128), (2, 4 * 128)]
    files = list(ds.dataset(f"{path}/region=A/year=2020/month=1").get_fragments())
    box = (ds.field("iy") >= 30) & (ds.field("iy") < 50) & (ds.field("ix") >= 60) & (ds.field("ix") < 80)
    touched = [f for f in files if f.subset(box).row_groups]
    assert len(files) >= 64 and len(touched) <= len(files) // 6
    rows = spark.read.parquet(path).filter("month = 1 and iy >= 30 and iy < 50 and ix >= 60 and ix < 80")
    assert rows.count() == 400 and rows.agg(F.sum("v")).first()[0] == sum(128 * i + j for i in range(30, 50) for j in range(60, 80))


def test_interleaving_and_strides(spark):
    got = {(r.y, r.x): r.z for r in spark.range(64).select((F.col("id") % 8).alias("y"), F.floor(F.col("id") / 8).cast("int").alias("x")).withColumn("z", D.interleaved("y", "x")).collect()}
    assert all(z == sum(((x >> b & 1) << 2 * b) + ((y >> b & 1) << (2 * b + 1)) for b in range(3)) for (y, x), z in got.items())
    grid = spark.createDataFrame([(r, i, j) for r, n in (("A", 20), ("B", 3)) for i in range(n) for j in range(n)], "region string, iy int, ix int")
    assert {r.region: r["count"] for r in D.thin_by_region(grid, 50).groupBy("region").count().collect()} == {"A": 49, "B": 9}


def test_tiles_of_a_new_folder_are_moved_by_tasks_and_later_ones_keep_the_rest(spark, tmp_path):
    from nivalis.plans import dense

    path = str(tmp_path / "tiles")
    rows = lambda r, v: spark.createDataFrame([(r, 2020, 1, i, j, v) for i in range(3) for j in range(3)], "region string, year int, month int, iy int, ix int, v double")
    dense.write_tiles(rows("A", 1.0).unionByName(rows("B", 2.0)), path)
    assert (tmp_path / "tiles" / "_SUCCESS").exists()  # not written to one side and moved folder by folder
    dense.write_tiles(rows("B", 3.0), path)
    assert sorted((r["region"], r["v"], r["count"]) for r in spark.read.parquet(path).groupBy("region", "v").count().collect()) == [("A", 1.0, 9), ("B", 3.0, 9)]


def test_small_regions_share_the_files_of_their_month_and_can_be_told_apart(spark, tmp_path):
    path = str(tmp_path / "tiles")
    rows = spark.range(200 * 3 * 4).select(F.format_string("R%03d", F.floor(F.col("id") / 12)).alias("region"), F.lit(2020).alias("year"), (F.col("id") % 3 + 1).cast("int").alias("month"), (F.floor(F.col("id") / 3) % 4).cast("int").alias("iy"), F.lit(0).alias("ix"))
    D.write_tiles(rows, path, ["year", "month"], cells_per_file=100, within=["region"])
    files = list(ds.dataset(path, format="parquet", partitioning="hive").get_fragments())
    assert len(files) <= 3 * (8 + 4)  # months x hundreds of cells and cuts, not x 200 regions
    touched = [f for f in files if f.subset(ds.field("region") == "R100").row_groups]
    assert 3 <= len(touched) <= 6
    assert sorted(map(tuple, spark.read.parquet(path).select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_the_months_query_makes_no_folder_for_each_region(spark, monkeypatch):
    from nivalis.plans import catalog

    made, write = [], D.write_tiles
    monkeypatch.setattr(D, "write_tiles", lambda df, path, *a, **b: (write(df, path, *a, **b), made.append(path)))
    catalog.queries()["l07_predict_months"](spark, "/root/testdata/sf0.001").count()
    assert not list(ds.dataset(made[0].removeprefix("file:"), format="parquet").files[0].split("/region=")[1:])

"""Variograms on the globe by blocks of sites against the join of all pairs."""

import datetime as dt
import random

import pytest

from nivalis.operators import blocks, pairs


@pytest.mark.parametrize("sizes", [{}, {"_SPAN": 7, "_SERIES": 3, "_VALUES": 20, "_BLOCK": 2}])
@pytest.mark.parametrize("by_region", [False, True])
def test_blocks_of_sites_find_every_pair_of_an_hour_once(spark, monkeypatch, sizes, by_region):
    for name, size in sizes.items():
        monkeypatch.setattr(blocks, name, size)
    rng, rows, began = random.Random(3), [], dt.datetime(2020, 1, 1)
    places = [(180.0, 80.0), (-179.5, 80.2), (10.0, 89.9), (-170.0, 89.8), (0.0, -90.0)] + [(rng.uniform(-180, 180), rng.uniform(76, 90)) for _ in range(40)]
    for site, (lon, lat) in enumerate(places):
        for _ in range(12):  # hours with gaps, some twice, some without a value
            hour = rng.choice([0, 1, 2, 5, 6, 30, 400])
            rows.append((f"s{site}", "AB"[site % 2], lon, lat, began + dt.timedelta(hours=hour, minutes=rng.randrange(60)), rng.choice([None, float("nan"), *(rng.uniform(-1e3, 1e3) for _ in range(8))])))
    rows.append((None, "A", 10.0, 89.9, began, 5.0))
    rows.append(("s2", "A", 11.0, 89.7, began, 7.0))  # a site that moved is no pair with itself
    df = spark.createDataFrame(rows, "site string, region string, lon double, lat double, time timestamp, v double")
    by = ["region"] if by_region else []
    shape = lambda out: {tuple(r[b] for b in [*by, "bin"]): (r["n_pairs"], r["gamma"]) for r in out.collect()}
    got = shape(pairs.field_variogram(df, "v", 300_000, 12, by_region, prefer_xy=False))
    all_pairs = pairs.same_hour_pairs(df, "v", 300_000, by_region, False)
    want = shape(pairs.variogram_of_pairs(all_pairs, 300_000, 12, by))
    assert got.keys() == want.keys() and sum(n for n, _ in want.values()) > 100
    for k, (n, gamma) in want.items():
        assert got[k] == (n, gamma if gamma is None else pytest.approx(gamma, rel=1e-9))


def test_a_site_is_sent_once_for_many_hours(spark):
    rows = [(s, float(s), 85.0, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), float(h)) for s in range(4) for h in range(500)]
    df = spark.createDataFrame(rows, "site int, lon double, lat double, time timestamp, v double")
    sent, _ = blocks._sent(df, "v", 300_000, (), "site")
    assert sent.count() <= 4 * 14 * 2  # not by the hour: cells, and spans that the hours touch


def test_no_rows_give_empty_bins(spark):
    df = spark.createDataFrame([], "site int, lon double, lat double, time timestamp, v double")
    assert [(r.bin, r.n_pairs, r.gamma) for r in pairs.field_variogram(df, "v", 1000, 2, prefer_xy=False).orderBy("bin").collect()] == [(0, 0, None), (1, 0, None)]


@pytest.mark.parametrize("sizes", [{}, {"_SPAN": 7, "_SERIES": 3, "_VALUES": 20, "_BLOCK": 2}])
@pytest.mark.parametrize("by_region", [False, True])
def test_blocks_in_the_plane_find_every_pair_of_an_hour_once(spark, monkeypatch, sizes, by_region):
    for name, size in sizes.items():
        monkeypatch.setattr(blocks, name, size)
    rng, rows, began = random.Random(4), [], dt.datetime(2020, 1, 1)
    for site in range(45):
        x, y = rng.uniform(-20_000, 20_000), 100.0 * rng.randrange(-90, 90)
        for _ in range(12):  # hours with gaps, some twice, some without a value
            hour = rng.choice([0, 1, 2, 5, 6, 30, 400])
            rows.append((f"s{site}", "AB"[site % 2], x, y, began + dt.timedelta(hours=hour, minutes=rng.randrange(60)), rng.choice([None, float("nan"), *(rng.uniform(-1e3, 1e3) for _ in range(8))])))
    rows += [(None, "A", 0.0, 0.0, began, 5.0), ("s2", "A", 1.0, 1.0, began, 7.0), ("n", None, 1.0, 1.0, began, 7.0), ("p", "A", None, 1.0, began, 7.0)]
    df = spark.createDataFrame(rows, "site string, region string, x double, y double, time timestamp, v double")
    by = ["region"] if by_region else []
    shape = lambda out: {tuple(r[b] for b in [*by, "bin"]): (r["n_pairs"], r["gamma"]) for r in out.collect()}
    got = shape(pairs.field_variogram(df, "v", 8000, 12, by_region))
    want = shape(pairs.variogram_of_pairs(pairs.same_hour_pairs(df, "v", 8000, by_region), 8000, 12, by))
    assert got.keys() == want.keys() and sum(n for n, _ in want.values()) > 100
    for k, (n, gamma) in want.items():
        assert got[k] == (n, gamma if gamma is None else pytest.approx(gamma, rel=1e-9))


def test_an_infinite_value_spoils_its_own_bins_only(spark):
    places, hours = [0.0, 10.0, 25.0, 95.0, 68.0], [dt.datetime(2020, 1, 1, h) for h in range(3)]
    value = lambda s, h: {(0, 1): float("inf"), (1, 1): float("inf"), (3, 2): float("-inf")}.get((s, h), float(s * s + h * s))
    df = spark.createDataFrame([(s, x, 0.0, t, value(s, h)) for s, x in enumerate(places) for h, t in enumerate(hours)], "site int, x double, y double, time timestamp, v double")
    shape = lambda out: {r.bin: (r.n_pairs, "None" if r.gamma is None else f"{r.gamma:.9g}") for r in out.collect()}
    got = shape(pairs.field_variogram(df, "v", 100, 10))
    assert got == shape(pairs.variogram_of_pairs(pairs.same_hour_pairs(df, "v", 100), 100, 10))
    assert {g for _, g in got.values()} > {"inf", "nan", "None"}


def test_a_variogram_in_the_plane_makes_no_row_for_a_meeting(spark, monkeypatch):
    monkeypatch.setattr(pairs, "same_hour_pairs", lambda *a, **b: pytest.fail("a row for every meeting"))
    rows = [(s, 100.0 * s, 0.0, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), float(s * h)) for s in range(4) for h in range(300)]
    df = spark.createDataFrame(rows, "site int, x double, y double, time timestamp, v double")
    assert {r.bin: r.n_pairs for r in pairs.field_variogram(df, "v", 400, 4).collect()} == {0: 0, 1: 900, 2: 600, 3: 300}
    assert blocks._sent(df, "v", 400, (), "site", True)[0].count() <= 4 * 2 * 2

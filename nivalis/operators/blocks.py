"""Variograms by blocks of sites, on the globe or in the plane.

The distance of two sites does not change from hour to hour, so pairs of sites are looked at once for a
span of hours, not once an hour.  A site's values of a span are one row, its series.  Sites fall into
cells of space as wide as the range, and crowded cells into parts; a task holds the series of one part
and lets those of the same cell and of the neighbours that come after it pass by, block by block.  Of
two blocks, counts, sums and squares by site and hour give all sums of squared differences as products
of matrices, so work an hour is that of the products alone, and memory that of a part and two blocks.
Pairs still grow with the square of the sites within the range of each other."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivalis.functions.physics import EARTH_RADIUS
from nivalis.tables import settle

#: Hours of a series; series and values of a part; sites of a block; series for each task.
_SPAN, _SERIES, _VALUES, _BLOCK, _SENT = 8192, 4096, 1_000_000, 128, 500


def _space(plane: bool) -> list[Column]:
    if plane:
        return [F.col("x"), F.col("y")]
    lon, lat = F.radians("lon"), F.radians("lat")
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _chord(max_range: float, plane: bool) -> float:
    # a little more for rounding; beyond half the globe one cell holds all
    if plane:
        return max_range * (1 + 1e-9)
    return 2 * math.sin(max_range / EARTH_RADIUS / 2) * (1 + 1e-9) if max_range < math.pi * EARTH_RADIUS else 4.0


class _Block:
    """Series of some sites: rows (site's place in the block, hour, value), and a ball around the sites."""

    def __init__(self, series: pd.DataFrame, plane: bool):
        self.key, self.site = series["key"].to_numpy(), np.repeat(np.arange(len(series)), series["hours"].map(len).to_numpy())
        self.hour, self.value = np.concatenate(list(series["hours"])), np.concatenate(list(series["values"]))
        self.finite = np.isfinite(self.value)
        if plane:
            place = self.place = series[["x", "y"]].to_numpy()
        else:
            lon, lat = self.place = np.radians(series[["lon", "lat"]].to_numpy()).T
            place = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
        self.centre = place.mean(axis=0)
        self.radius = np.sqrt(((place - self.centre) ** 2).sum(axis=1).max())


def _apart(a: _Block, b: _Block, plane: bool) -> np.ndarray:
    """Distances of the sites of two blocks."""
    if plane:
        return np.hypot(b.place[:, 0] - a.place[:, 0, None], b.place[:, 1] - a.place[:, 1, None])
    (lon1, lat1), (lon2, lat2) = a.place, b.place
    h = np.sin((lat2 - lat1[:, None]) / 2) ** 2 + np.cos(lat1)[:, None] * np.cos(lat2) * np.sin((lon2 - lon1[:, None]) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def _tables(site: np.ndarray, at: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
    """Count, sum and sum of squares by site and hour."""
    place, size = site * shape[1] + at, shape[0] * shape[1]
    return [np.bincount(place, w, size).reshape(shape) for w in (None, value, value * value)]


def _products(a: tuple, b: tuple, hours: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds, for each pair of sites, the pairs of values of equal hours and their squared differences.
    a, b: sites, hours and values of rows. Hours are halved while most sites lack most of them."""
    a, b = (tuple(x[np.isin(side[1], hours)] for x in side) for side in (a, b))
    if not (len(a[0]) and len(b[0])):
        return
    (one, i), (two, j) = (np.unique(side[0], return_inverse=True) for side in (a, b))
    if len(hours) > 1 and (len(one) + len(two)) * len(hours) > 32 * (len(i) + len(j)):
        for half in np.array_split(hours, 2):
            _products(a, b, half, counts, sums)
        return
    n1, s1, q1 = _tables(i, np.searchsorted(hours, a[1]), a[2], (len(one), len(hours)))
    n2, s2, q2 = _tables(j, np.searchsorted(hours, b[1]), b[2], (len(two), len(hours)))
    at = np.ix_(one, two)
    counts[at] += n1.astype(np.float64) @ n2.T.astype(np.float64)
    sums[at] += np.hstack((n1, q1, -2 * s1)) @ np.hstack((q2, n2, s2)).T


def _one_by_one(a: tuple, b: tuple, counts: np.ndarray, sums: np.ndarray) -> None:
    """What _products() adds, value by value: for infinite values, which would spoil a product of matrices."""
    met = pd.merge(*(pd.DataFrame(dict(zip(("site", "hour", "value"), side, strict=True))) for side in (a, b)), on="hour")
    with np.errstate(invalid="ignore"):
        np.add.at(counts, (met["site_x"], met["site_y"]), 1.0)
        np.add.at(sums, (met["site_x"], met["site_y"]), (met["value_x"] - met["value_y"]) ** 2)


def _meet(a: _Block, b: _Block, max_range: float, n_bins: int, total: np.ndarray, plane: bool) -> None:
    """Adds to total (2, bins) the number of pairs of two blocks, or of one, and half their squares."""
    if np.sqrt(((a.centre - b.centre) ** 2).sum()) > _chord(max_range, plane) + a.radius + b.radius:
        return
    distance = _apart(a, b, plane)
    keys, _ = pd.factorize(np.concatenate((a.key, b.key)))
    near = (distance < max_range) & (keys[: len(a.key), None] != keys[None, len(a.key) :])
    if a is b:
        near &= np.tri(len(a.key), k=-1, dtype=bool).T
    hours = np.intersect1d(a.hour, b.hour)
    if not near.any() or not len(hours):
        return
    counts, sums = np.zeros(near.shape), np.zeros(near.shape)
    middle = a.value[a.finite].mean() if a.finite.any() else 0.0  # sums of squares of small numbers lose least
    some = lambda side, which: (side.site[which], side.hour[which], side.value[which] - middle)
    _products(some(a, a.finite), some(b, b.finite), hours, counts, sums)
    if not (a.finite.all() and b.finite.all()):
        _one_by_one(some(a, ~a.finite), some(b, np.full(len(b.site), True)), counts, sums)
        _one_by_one(some(a, a.finite), some(b, ~b.finite), counts, sums)
    bins = np.floor(distance[near] / (max_range / n_bins)).astype(np.int64)
    for k, x in enumerate((counts, np.maximum(sums, 0) / 2)):
        total[k] += np.bincount(bins, x[near], n_bins + 1)[:n_bins]


def _sent(df: DataFrame, value: str, max_range: float, by: Sequence[str], key: str, plane: bool = False) -> tuple[DataFrame, list[str]]:
    """Series with the part they go to (by, span, t0, t1, and t2 on the globe, part), and whether they pass by (passes)."""
    place, space, width = ["x", "y"] if plane else ["lon", "lat"], _space(plane), _chord(max_range, plane)
    axes = range(len(space))
    cell, fine, aim = ([f"{p}{k}" for k in axes] for p in "cft")
    base = df.dropna(subset=[*place, value, key, *by]).withColumn("_h", F.floor(F.unix_timestamp(F.date_trunc("hour", "time")) / 3600)).dropna(subset=["_h"])
    rows = base.select(*by, F.col(key).alias("key"), *(F.col(p).cast("double") for p in place), F.floor(F.col("_h") / _SPAN).alias("span"), F.pmod("_h", F.lit(_SPAN)).cast("int").alias("hour"), F.col(value).cast("double").alias("value"))
    packed = rows.groupBy(*by, "span", "key", *place).agg(F.collect_list(F.struct("hour", "value")).alias("_v"))
    cells = {c: F.floor(p / width) for c, p in zip(cell, space, strict=True)}
    finer = {f: F.floor(4 * p / width) for f, p in zip(fine, space, strict=True)}
    series = settle(packed.withColumns(cells | finer | {"hours": F.col("_v.hour"), "values": F.col("_v.value")}).drop("_v"), "series", tidy=True)
    own = [*by, "span"]
    most = F.greatest(F.ceil(F.count("*") / _SERIES), F.ceil(F.sum(F.size("hours")) / _VALUES)).cast("int")
    places = settle(series.groupBy(*own, *cell).agg(most.alias("parts"), F.count("*").alias("n")), "places")
    after = [step for step in product((-1, 0, 1), repeat=len(axes)) if step >= (0,) * len(axes)]
    steps = F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(cell, step, strict=True)), F.lit(any(step)).alias("next")) for step in after))
    target = F.struct(*(F.col(c).alias(t) for c, t in zip(cell, aim, strict=True)), "parts").alias("target")
    around = places.select(*own, target, F.explode(steps).alias("_s")).select(*own, "target", "_s.*").join(places.drop("n"), [*own, *cell])
    targets = around.groupBy(*own, *cell, "parts").agg(F.collect_list(F.struct("target", "next")).alias("targets"))
    met = series.join(targets, [*own, *cell]).withColumn("_part", F.pmod(F.xxhash64("key", *place), F.col("parts")).cast("int"))

    def parts_of(t: Column) -> Column:
        last = F.when(t["next"], t["target"]["parts"] - 1).otherwise(F.col("_part"))
        passes = lambda p: t["next"] | (p != F.col("_part"))
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(*(t["target"][k].alias(k) for k in aim), p.alias("part"), passes(p).alias("passes")))

    group = [*own, *aim, "part"]
    sent = met.withColumn("_to", F.explode(F.flatten(F.transform("targets", parts_of)))).select(*own, "_to.*", "key", *place, *fine, "hours", "values")
    found = places.agg(F.sum("n")).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(1000, found // _SENT))
    return sent.repartition(tasks, *group).sortWithinPartitions(*group, "passes", *fine), group


def binned_pairs(df: DataFrame, value: str, max_range: float, n_bins: int, by: Sequence[str] = (), key: str = "site", plane: bool = False) -> DataFrame:
    """(by, bin, gamma, n_pairs) of bins that hold pairs: pairs of sites in one hour by distance, on the
    great circle or in the plane (x, y), and the mean of half their squared difference."""
    sent, group = _sent(df, value, max_range, by, key, plane)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, rest, total = None, [], None, np.zeros((2, n_bins))

        def pass_by(block: _Block) -> None:
            for held in own:
                _meet(held, block, max_range, n_bins, total, plane)

        def done() -> pd.DataFrame:
            made = pd.DataFrame({"bin": np.arange(n_bins), "n": total[0].round().astype(np.int64), "s": total[1]})
            return made.assign(**{b: v for b, v in zip(by, at, strict=False)})[[*by, "bin", "n", "s"]]

        for pdf in batches:
            for name, part in pdf.groupby(group, sort=False, dropna=False):
                if name != at:
                    if at is not None:
                        yield done()
                    at, own, total = name, [], np.zeros((2, n_bins))
                for passes, side in part.groupby("passes", sort=True):
                    for lo in range(0, len(side), _BLOCK):
                        block = _Block(side.iloc[lo : lo + _BLOCK], plane)
                        pass_by(block)
                        if not passes:
                            _meet(block, block, max_range, n_bins, total, plane)
                            own.append(block)
        if at is not None:
            yield done()

    types = dict(df.select(*by).dtypes)
    made = sent.mapInPandas(run, ", ".join([*(f"`{b}` {types[b]}" for b in by), "bin int", "n long", "s double"]))
    total = F.sum(F.coalesce("s", F.lit(math.nan)))  # what is no number comes back as null
    return made.filter("n > 0").groupBy(*by, "bin").agg((total / F.sum("n")).alias("gamma"), F.sum("n").alias("n_pairs"))

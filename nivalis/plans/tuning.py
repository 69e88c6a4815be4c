"""Search for settings of boosted trees, by validation curves over week folds.

A trial fits every fold.  Of each fit the root mean squared error on the rows held out is taken after
every boosting round, all rounds in one pass, in which rows go down the trees in numpy, column by column,
and become a sum of squares for each round; a fold's score is that of its best round, a trial's the
mean over its folds, and the round kept is the best of the mean curve.  Rows lie in a folder for each fold,
in files of a bounded number of them.

The search goes by rungs: all trials are fitted with few rounds, the better share of them again with
more, up to the rounds asked for.  The first trial, the defaults, is never dropped, so it is fitted once with
all its rounds: the first rounds of a fit are those of a shorter one.  Fits of a rung run
side by side as Spark jobs; no data but curves reaches the driver."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivalis.plans.attribution import saved_trees
from nivalis.plans.folds import _side_by_side as side_by_side
from nivalis.plans.modelling import TREES, feature_vector, tasks_of, week_folds
from nivalis.tables import settle


def _arrays(trees: pd.DataFrame) -> list[tuple]:
    """Of each tree: by node feature, threshold, the nodes below it by turns, and weighted value. Leaves lead to themselves."""
    out = []
    for _, own in trees.sort_values(["tree", "node"]).groupby("tree", sort=True):
        leaf, here = own["feature"].to_numpy() < 0, own["node"].to_numpy()
        feature, threshold, left, right = (np.where(leaf, at, own[c].to_numpy()) for c, at in (("feature", 0), ("threshold", np.inf), ("left", here), ("right", here)))
        out.append((feature, threshold, np.stack([left, right], axis=1).ravel(), (own["weight"] * own["value"]).to_numpy()))
    return out


def validation_curve(fitted, features: Sequence[str], check: DataFrame, target: str) -> list[float]:
    """Root mean squared errors on `check` after 1, 2, ... rounds of a fitted model, in one pass. Rows with a
    missing feature are left out."""
    table, depth = saved_trees(fitted, check)
    trees, names = _arrays(table.toPandas()), [f"_f{k}" for k in range(len(features))]  # as large as the model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares, n = np.zeros(len(trees)), 0
        for pdf in batches:
            x, rest = np.concatenate([pdf[c].to_numpy(np.float64) for c in names]), pdf["_label"].to_numpy(np.float64)
            rows, n = np.arange(len(rest)), n + len(rest)
            for k, (feature, threshold, below, value) in enumerate(trees):
                node = np.zeros(len(rest), np.int64)
                for _ in range(depth):
                    beyond = x.take(feature.take(node) * len(rest) + rows) > threshold.take(node)
                    node = below.take(2 * node + beyond)
                rest = rest - value.take(node)
                squares[k] += rest @ rest
        if n:
            yield pd.DataFrame({"round": np.arange(1, len(trees) + 1), "squares": squares, "n": n})

    placed = check.select(*(F.col(f).cast("double").alias(c) for f, c in zip(features, names, strict=True)), F.col(target).cast("double").alias("_label"))
    whole = placed.dropna(subset=names).filter("_label is not null")
    sums = whole.mapInPandas(run, "round int, squares double, n long").groupBy("round")
    total = F.sum(F.coalesce("squares", F.lit(math.nan)))  # what is no number comes back as null
    return [r["rmse"] for r in sums.agg(F.sqrt(total / F.sum("n")).alias("rmse")).orderBy("round").collect()]


def _side_by_side(jobs: Sequence, parallelism: int) -> list:
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(lambda job: job()), jobs))


def tune(train: DataFrame, features: Sequence[str], target: str, space: Mapping[str, Sequence], trials: int = 20, folds: int = 3, seed: int = 33, base: Mapping | None = None, eta: int = 3, least: int = 10, parallelism: int = 4) -> tuple[dict, DataFrame]:
    """The best settings, maxIter being the best round, and the table of fits: number (of the trial),
    rung, rounds (fitted), value (the score), round (the best), params. `eta` is the share kept from rung
    to rung, one in eta, and by how much the rounds grow; `least` are the rounds of the first rung."""
    rng = random.Random(seed)
    tried = [dict(base or {})] + [dict(base or {}) | {k: rng.choice(list(v)) for k, v in space.items()} for _ in range(trials - 1)]
    most = [int((TREES | s)["maxIter"]) for s in tried]
    spark = train.sparkSession
    placed = week_folds(train.dropna(subset=[*features, target]), folds, seed).select(*features, F.col(target).alias("label"), "foldCol")
    folded = settle(placed.repartition(tasks_of(spark, train.count()), "foldCol", F.xxhash64(*features, "label")), "folded", by=["foldCol"])
    sizes = {r["foldCol"]: r["count"] for r in folded.groupBy("foldCol").count().collect()}
    used = [k for k in range(folds) if 0 < sizes.get(k, 0) < sum(sizes.values())]
    parallelism = side_by_side(spark, [sum(sizes.values()) - sizes[k] for k in used] or [1], parallelism)

    def curve(number: int, rounds: int, k: int) -> list[float]:
        part = feature_vector(features).transform(folded.filter(F.col("foldCol") != k))
        model = GBTRegressor(**(TREES | tried[number] | {"maxIter": rounds})).fit(part)
        return validation_curve(model, features, folded.filter(F.col("foldCol") == k), "label")

    rows, alive, rung, known = [], list(range(trials)), 0, {}
    while True:
        budget = least * eta**rung
        jobs = [(n, min(budget, most[n]), k) for n in alive for k in used]
        asked = [(n, most[n] if n == 0 else rounds, k) for n, rounds, k in jobs]
        known |= dict(zip(new := [j for j in asked if j not in known], _side_by_side([lambda j=j: curve(*j) for j in new], parallelism), strict=True))
        curves = [known[a][:rounds] for a, (_, rounds, _) in zip(asked, jobs, strict=True)]
        scores = {}
        for n in alive:
            own = [c for (m, _, _), c in zip(jobs, curves, strict=True) if m == n]
            mean = [sum(x) / len(x) for x in zip(*own, strict=True)] or [math.inf]
            best = min(range(len(mean)), key=mean.__getitem__)
            scores[n] = (sum(map(min, own)) / len(own) if own else math.inf, best + 1)
            rows.append((n, rung, min(budget, most[n]), *scores[n], {k: float(v) for k, v in tried[n].items()}))
        if all(budget >= most[n] for n in alive):
            break
        ranked = sorted(alive, key=lambda n: (scores[n][0], n))
        alive, rung = sorted({0, *ranked[: max(1, math.ceil(len(ranked) / eta))]}), rung + 1
    number = min(alive, key=lambda n: (scores[n][0], n))
    table = train.sparkSession.createDataFrame(rows, "number int, rung int, rounds int, value double, round int, params map<string,double>")
    return tried[number] | {"maxIter": scores[number][1]}, table

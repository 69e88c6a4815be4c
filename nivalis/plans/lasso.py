"""Bagged lasso from sufficient statistics.

Rows fall into hashed groups.  One aggregate gives, for each group and target, the sums of products of
all columns; it is as large as groups x targets x columns squared, whatever the rows.  A bag is a drawn
share of groups and of features, and its folds share out its groups, so the statistics of every bag,
every fold and every fold's complement are sums of those of groups.  From there on no row is read: all
bags and folds descend together, coordinate by coordinate, along a path of penalties.

The loss is 1/(2n) |y - z w|^2 + penalty |w|_1 with columns z centred and scaled to a deviation of 1.
The path goes from the least penalty that leaves no feature down to a thousandth of it, as many steps as
`penalties`; of each bag and target the penalty of the least mean squared error over its folds is kept."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_group(keys: Sequence[str], groups: int, seed: int):
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(groups)).cast("int")


def group_statistics(df: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str], groups: int, seed: int) -> np.ndarray:
    """(group, target, column, column) sums of products of the columns 1, features and the target, over
    rows that have the target: one aggregate."""
    every = df.select(row_group(keys, groups, seed).alias("g"), F.array(F.lit(1.0), *(F.col(f).cast("double") for f in features)).alias("z"), F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col(t).cast("double").alias("y")) for k, t in enumerate(targets)))).alias("e"))
    known = every.filter(F.col("e.y").isNotNull() & ~F.isnan("e.y")).select("g", "e.t", F.concat("z", F.array("e.y")).alias("z"))
    size = len(features) + 2
    by_column = known.select("g", "t", "z", F.posexplode("z").alias("i", "v")).groupBy("g", "t", "i").agg(*(F.sum(F.col("v") * F.get("z", F.lit(j))).alias(f"s{j}") for j in range(size)))
    out = np.zeros((groups, len(targets), size, size))
    for row in by_column.collect():  # groups x targets x columns rows
        out[row["g"], row["t"], row["i"]] = row[3:]
    return out


def moments(stats: np.ndarray) -> dict[str, np.ndarray]:
    """Centred and scaled moments of problems (..., column, column): n, mean and deviation of the
    features, their products a row, those with the target, and the target's mean."""
    n = np.maximum(stats[..., 0, 0], 1)
    mean = stats[..., 0, 1:] / n[..., None]
    products = stats[..., 1:, 1:] / n[..., None, None] - mean[..., :, None] * mean[..., None, :]
    spread = np.sqrt(np.maximum(np.diagonal(products, axis1=-2, axis2=-1), 0) * (n / np.maximum(n - 1, 1))[..., None])
    scale = np.where(spread[..., :-1] > 1e-12, spread[..., :-1], np.inf)  # a constant column stays out
    return {
        "n": n, "mean": mean[..., :-1], "scale": scale, "start": mean[..., -1],
        "gram": products[..., :-1, :-1] / scale[..., :, None] / scale[..., None, :], "cross": products[..., :-1, -1] / scale,
    }


def descend(gram: np.ndarray, cross: np.ndarray, penalty: np.ndarray, weights: np.ndarray, sweeps: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of all problems (problem, feature) at once, from a start."""
    weights, size = weights.copy(), np.abs(cross).max(axis=1, initial=0) + 1e-300
    left = cross - np.einsum("pij,pj->pi", gram, weights)
    for _ in range(sweeps):
        most = 0.0
        for j in range(weights.shape[1]):
            own = gram[:, j, j]
            pull = left[:, j] + own * weights[:, j]
            fresh = np.where(own > 0, np.sign(pull) * np.maximum(np.abs(pull) - penalty, 0) / np.where(own > 0, own, 1), 0)
            step = fresh - weights[:, j]
            if step.any():
                left -= step[:, None] * gram[:, j]
                weights[:, j] = fresh
                most = max(most, float((np.abs(step) / size).max()))
        if most < tolerance:
            break
    return weights


def _errors(weights: np.ndarray, m: dict, held: np.ndarray) -> np.ndarray:
    """Mean squared error of scaled weights on held-out statistics (problem, column, column)."""
    plain = weights / m["scale"]
    whole = np.concatenate(((m["start"] - (plain * m["mean"]).sum(axis=1))[:, None], plain, -np.ones((len(plain), 1))), axis=1)
    return np.einsum("pi,pij,pj->p", whole, held, whole) / np.maximum(held[:, 0, 0], 1)


def fit_bags(stats: np.ndarray, features: Sequence[str], targets: Sequence[str], bags: int, row_share: float, feature_share: float, folds: int, penalties: int, penalty: float | None, seed: int) -> tuple[dict, dict]:
    """For each target its bags (features, weights, intercept), and the penalty of each. With a given
    penalty no fold is looked at."""
    rng = random.Random(seed)
    groups, q = len(stats), max(1, round(len(features) * feature_share))
    chosen = []
    for _ in range(bags):
        names = sorted(rng.sample(range(len(features)), q))
        chosen.append((names, rng.sample(range(groups), max(folds, round(groups * row_share)) if penalty is None else max(1, round(groups * row_share)))))
    parts = []  # statistics of (bag, fold, target)
    for names, own in chosen:
        at = np.array([0, *(k + 1 for k in names), len(features) + 1])
        cut = stats[np.ix_(own, range(len(targets)), at, at)]
        parts.append([cut.sum(axis=0), *(cut[k::folds].sum(axis=0) for k in range(folds if penalty is None else 0))])
    parts = np.array(parts)
    whole = parts[:, 0].reshape(-1, *parts.shape[3:])
    m = moments(whole)
    if penalty is None:
        held = parts[:, 1:]
        rest = (parts[:, :1] - held).reshape(-1, *parts.shape[3:])
        inner, held = moments(rest), held.reshape(-1, *parts.shape[3:])
        top = np.maximum(np.abs(m["cross"]).max(axis=1), 1e-12)
        path = top[:, None] * np.logspace(0, -3, penalties)
        each = np.broadcast_to(path.reshape(bags, 1, len(targets), penalties), (bags, folds, len(targets), penalties)).reshape(-1, penalties)
        weights, error = np.zeros(inner["cross"].shape), np.empty((penalties, bags, folds, len(targets)))
        for k in range(penalties):
            weights = descend(inner["gram"], inner["cross"], each[:, k], weights)
            error[k] = _errors(weights, inner, held).reshape(bags, folds, len(targets))
        best = path[np.arange(len(path)), error.mean(axis=2).argmin(axis=0).ravel()]
    else:
        best = np.full(len(whole), float(penalty))
    plain = descend(m["gram"], m["cross"], best, np.zeros(m["cross"].shape)) / m["scale"]
    start = m["start"] - (plain * m["mean"]).sum(axis=1)
    models: dict[str, list] = {t: [] for t in targets}
    used: dict[str, list[float]] = {t: [] for t in targets}
    for b, (names, _) in enumerate(chosen):
        for k, t in enumerate(targets):
            p = b * len(targets) + k
            models[t].append(([features[i] for i in names], list(map(float, plain[p])), float(start[p])))
            used[t].append(float(best[p]))
    return models, used

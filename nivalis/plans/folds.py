"""Models of every (region, year) fold from one predictor table, and their registry.

A fold's models see other regions and other years only, and are judged on its own region and year.  All
folds read one table, written in a folder for each region and year, so that a fold reads no other rows than
its own and those it learns from.  Several are fitted at a time.  A fold is finished by its registry entry, a small
table of a row a kind of model, written under another name and moved into place after its models and
predictions are there; so a restart fits what has no entry, and half-written models are written over.

    <folder>/models/<kind>/<fold>        saved models
    <folder>/predictions/<fold>          predictions on the fold's own rows, all kinds side by side
    <folder>/registry/fold=<fold>        region, model_year, kind, path, features, n_train, n, skill"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.plans.modelling import TASK_ROWS, BaggedLinear, OffsetModel, model_for, predict_sites, skill_of
from nivalis.tables import delete, recording, settle

#: What loads a kind of model; others are given to fit_folds and load_model.
LOADERS: dict[str, Callable] = {"boosted": OffsetModel.load, "lasso": BaggedLinear.load}
#: Rows a core that folds fitted side by side may learn from; a fit holds a row in about 250 bytes.
CORE_ROWS = 6_000_000
_REGISTRY = "region string, model_year int, kind string, path string, features array<string>, n_train long, n long, corr_fit double, rmse_fit double, corr_raw double, rmse_raw double"


@dataclass(frozen=True)
class Fold:
    region: str
    year: int

    @property
    def name(self) -> str:
        return f"{quote(self.region, safe='')}-{self.year}"


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _cells(table: DataFrame, targets: Sequence[str]) -> dict[Fold, int]:
    """The rows of every region and year that have any."""
    rows = table.dropna(subset=list(targets)).groupBy("region", F.year("time").alias("year")).agg(F.count("*").alias("n")).dropna().collect()  # regions x years
    return dict(sorted(((Fold(r["region"], r["year"]), r["n"]) for r in rows), key=lambda x: (x[0].region, x[0].year)))


def _apart(fold: Fold, cells: Iterable[Fold]) -> list[Fold]:
    return [g for g in cells if g.region != fold.region and g.year != fold.year]


def folds_of(table: DataFrame, targets: Sequence[str]) -> list[Fold]:
    """Folds with rows to judge by and rows to learn from."""
    cells = _cells(table, targets)
    return [f for f in cells if _apart(f, cells)]


def _laid(table: DataFrame, targets: Sequence[str], cells: Mapping[Fold, int], keys: Sequence[str]) -> tuple[DataFrame, dict[Fold, int]]:
    """The rows with all targets, in a folder for each region and year, by its number _cell, and in files of
    about TASK_ROWS; and the numbers."""
    spark, numbers = table.sparkSession, {f: k for k, f in enumerate(cells)}
    known = spark.createDataFrame([(f.region, f.year, numbers[f], math.ceil(n / TASK_ROWS)) for f, n in cells.items()], "_region string, _year int, _cell int, _parts int")
    met = table.dropna(subset=list(targets)).join(F.broadcast(known), (F.col("region") == F.col("_region")) & (F.year("time") == F.col("_year")))
    tasks = max(spark.sparkContext.defaultParallelism, sum(math.ceil(n / TASK_ROWS) for n in cells.values()))
    shared = met.repartition(tasks, "_cell", F.pmod(F.xxhash64(*keys), F.col("_parts")))
    return settle(shared.drop("_region", "_year", "_parts"), "laid", by=["_cell"]), numbers


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of all finished folds."""
    path, files = _path(spark, f"{folder}/registry")
    done = [str(s.getPath()) for s in files.listStatus(path) if s.getPath().getName().startswith("fold=")] if files.exists(path) else []
    return spark.read.schema(_REGISTRY).parquet(*done) if done else spark.createDataFrame([], _REGISTRY)


def _finished(spark: SparkSession, folder: str) -> set[str]:
    path, files = _path(spark, f"{folder}/registry")
    return {s.getPath().getName().removeprefix("fold=") for s in files.listStatus(path)} if files.exists(path) else set()


def _put(df: DataFrame, folder: str) -> None:
    """Write a table, by the tasks that made it, under another name and move it into place."""
    spark = df.sparkSession
    passing = f"{folder.rpartition('/')[0]}/.passing-{uuid.uuid4().hex}"
    df.write.parquet(passing)
    to, files = _path(spark, folder)
    files.delete(to, True)
    if not files.rename(_path(spark, passing)[0], to):
        raise OSError(f"{passing} could not be moved to {folder}")


def _side_by_side(spark: SparkSession, rows: Sequence[int], parallelism: int) -> int:
    """Folds fitted at once: `parallelism`, or as many as executors can hold."""
    return max(1, min(parallelism, CORE_ROWS * spark.sparkContext.defaultParallelism // max(rows)))


def fit_folds(table: DataFrame, features: Sequence[str], target: str, folder: str, fitters: Mapping[str, Callable[[DataFrame], object]], base: str = "skt", keys: Sequence[str] = ("region", "site", "time"), kelvin: bool = True, parallelism: int = 4) -> DataFrame:
    """Fit what the registry lacks and return it. `table` has the keys, features, <target>, <target>_offset
    and the base field, and should be written. `fitters` give a model, with transform and save, of the
    training rows, for each kind; these lie in files of about TASK_ROWS. At most `parallelism` folds are fitted at
    once, fewer if their rows are many."""
    spark, offset = table.sparkSession, f"{target}_offset"
    done, cells = _finished(spark, folder), _cells(table, [offset])
    wanted = [f for f in cells if _apart(f, cells) and f.name not in done]
    if not wanted:
        return registry(spark, folder)
    passing: list[str] = []
    with recording(passing):
        laid, numbers = _laid(table, [offset], cells, keys)

    def fit(fold: Fold) -> None:
        others = _apart(fold, cells)
        train = laid.filter(F.col("_cell").isin([numbers[g] for g in others])).drop("_cell")
        check = laid.filter(F.col("_cell") == numbers[fold]).drop("_cell")
        n_train, entries, predictions = sum(cells[g] for g in others), None, None
        for kind, fitter in fitters.items():
            path = f"{folder}/models/{kind}/{fold.name}"
            fitter(train).save(spark, path)
            model = load_model(spark, kind, path)
            # target and base field go along, so that predictions need no join to be judged
            predicted = predict_sites(model, check, base, [*dict.fromkeys([*keys, target, base])], kelvin)
            own = skill_of(predicted, target, base, ("region",), kelvin)
            entry = own.select(
                "region", F.lit(fold.year).alias("model_year"), F.lit(kind).alias("kind"), F.lit(path).alias("path"),
                F.array(*(F.lit(f) for f in features)).alias("features"), F.lit(n_train).cast("long").alias("n_train"), "n", "corr_fit", "rmse_fit", "corr_raw", "rmse_raw",
            )
            named = predicted.select(*keys, F.col(f"predicted_{target}").alias(f"{kind}_{target}"))
            entries = entry if entries is None else entries.unionByName(entry)
            predictions = named if predictions is None else predictions.join(named, list(keys), "full")
        _put(predictions, f"{folder}/predictions/{fold.name}")
        _put(entries.coalesce(1), f"{folder}/registry/fold={fold.name}")

    try:
        with ThreadPoolExecutor(_side_by_side(spark, [sum(cells[g] for g in _apart(f, cells)) for f in wanted], parallelism)) as pool:
            list(pool.map(inheritable_thread_target(fit), wanted))
    finally:
        delete(spark, passing)
    return registry(spark, folder)


def load_model(spark: SparkSession, kind: str, path: str):
    return LOADERS[kind](spark, path)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every fold's predictions on its own rows."""
    path, files = _path(spark, f"{folder}/predictions")
    return spark.read.parquet(*(str(s.getPath()) for s in files.listStatus(path) if not s.getPath().getName().startswith(".")))


def models_for(known: DataFrame, wanted: DataFrame, kind: str, seed: int = 5) -> dict[tuple[str, int], object]:
    """The model of each wanted (region, year): that of the year, else one of the region's by hash. A
    model that serves several is loaded once."""
    own = known.filter(F.col("kind") == kind).select("region", "model_year", F.col("path").alias("model"))
    chosen = model_for(own, wanted.select("region", "year").distinct(), seed).collect()  # regions x years
    loaded = {path: load_model(wanted.sparkSession, kind, path) for path in sorted({r["model"] for r in chosen})}
    return {(r["region"], r["year"]): loaded[r["model"]] for r in chosen}


def predict_with(models: Mapping[tuple[str, int], object], rows: DataFrame, base: str = "skt", keys: Sequence[str] = ("region", "site", "time"), kelvin: bool = True) -> DataFrame:
    """Rows of every (region, year) predicted by its model; a model that serves several reads them together."""
    served: dict[int, list[tuple[str, int]]] = {}
    for place, model in models.items():
        served.setdefault(id(model), []).append(place)
    parts = []
    for places in served.values():
        mine = reduce(lambda a, b: a | b, ((F.col("region") == r) & (F.year("time") == y) for r, y in places))
        parts.append(predict_sites(models[places[0]], rows.filter(mine), base, keys, kelvin))
    return reduce(DataFrame.unionByName, parts)

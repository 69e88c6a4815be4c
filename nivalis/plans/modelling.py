"""Fitting and applying temperature-offset models as Spark jobs."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Bucketizer, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nivalis.plans import lasso
from nivalis.tables import settle

OFFSETS = ("T1_offset", "T2_offset", "T3_offset")
# Default settings of the boosted trees and of the bagged sparse linear model.
TREES = {"maxIter": 500, "stepSize": 0.03, "maxDepth": 8, "maxBins": 256, "subsamplingRate": 0.65, "minInstancesPerNode": 2, "seed": 99}
#: Rows of a task of a boosted fit, which holds them as points of about 250 bytes.
TASK_ROWS = 250_000
BAGS = {"bags": 50, "row_share": 0.6, "feature_share": 0.6}


def holdout_split(df: DataFrame, region: str, year: int, targets: Sequence[str] = OFFSETS) -> tuple[DataFrame, DataFrame]:
    """Train on other regions and other years, validate on that region and year; rows need all targets."""
    whole = df.dropna(subset=list(targets))
    y = F.year("time")
    return whole.filter((F.col("region") != region) & (y != year)), whole.filter((F.col("region") == region) & (y == year))


def fold_roles(df: DataFrame, targets: Sequence[str] = OFFSETS) -> DataFrame:
    """Rows of every (region, year) fold at once, counted by role."""
    whole = df.dropna(subset=list(targets)).select("region", F.year("time").alias("year"))
    cells = whole.groupBy("region", "year").agg(F.count("*").alias("n"))
    folds = cells.select(F.col("region").alias("fold_region"), F.col("year").alias("fold_year"))
    other = (F.col("region") != F.col("fold_region")) & (F.col("year") != F.col("fold_year"))
    same = (F.col("region") == F.col("fold_region")) & (F.col("year") == F.col("fold_year"))
    role = F.when(other, "train").when(same, "validation")
    met = folds.crossJoin(F.broadcast(cells)).withColumn("role", role).filter("role is not null")  # regions x years rows
    return met.groupBy("fold_region", "fold_year", "role").agg(F.sum("n").alias("n"))


def week_folds(df: DataFrame, k: int = 3, seed: int = 33, time_col: str = "time") -> DataFrame:
    """Adds foldCol; all rows of an ISO week number share a fold."""
    week = F.weekofyear(time_col)
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", week.cast("string"), F.lit(str(seed)))), 1, 6), 16, 10).cast("int")
    return df.withColumn("foldCol", (digest % k).cast("int"))


def feature_vector(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def _note(spark: SparkSession, path: str, what: dict) -> None:
    spark.createDataFrame([(json.dumps(what),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _noted(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


@dataclass
class OffsetModel:
    """Models of all targets, the features they need and the start value of each."""

    features: list[str]
    stages: dict[str, PipelineModel]
    start: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"features missing: {missing}")
        for target, model in self.stages.items():
            df = model.transform(df).withColumn(f"predicted_{target}", F.col("prediction") + self.start.get(target, 0.0)).drop("prediction", "features")
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a folder, over a model that is there."""
        for target, model in self.stages.items():
            model.write().overwrite().save(f"{path}/stages/{target}")
        _note(spark, f"{path}/about", {"features": self.features, "targets": list(self.stages), "start": self.start})

    @staticmethod
    def load(spark: SparkSession, path: str) -> OffsetModel:
        about = _noted(spark, f"{path}/about")
        return OffsetModel(about["features"], {t: PipelineModel.load(f"{path}/stages/{t}") for t in about["targets"]}, about["start"])


def with_vector(df: DataFrame, features: Sequence[str], tasks: int) -> DataFrame:
    """Adds the features as _vector; rows lie in `tasks` partitions. Rows that lack a feature go."""
    return feature_vector(features).setOutputCol("_vector").transform(df).repartition(tasks)


def put_together(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds the features as _vector, which is null in rows that lack one; rows stay where they are."""
    whole = ~F.greatest(F.lit(False), *(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in features))
    made = feature_vector(features).setHandleInvalid("keep").setOutputCol("_vector").transform(df)
    return made.withColumn("_vector", F.when(whole, F.col("_vector")))


def tasks_of(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def boosted_offsets(train: DataFrame, features: Sequence[str], targets: Sequence[str] = OFFSETS, **settings) -> OffsetModel:
    """Gradient-boosted trees for each target, started at its median. Features are put together once, and
    rows dealt over tasks of a bounded number of them, unless with_vector() or put_together() has done so."""
    spark, made = train.sparkSession, "_vector" in train.columns
    row = train.agg(F.count("*").alias("_n"), *(F.percentile_approx(t, 0.5, 10_000).alias(f"_at_{t}") for t in targets)).first()
    start = {t: float(row[f"_at_{t}"]) for t in targets}
    shaped = train.filter("_vector is not null") if made else with_vector(train.select(*dict.fromkeys([*features, *targets])), features, tasks_of(spark, row["_n"]))
    stages = {}
    for t in targets:
        fitted = GBTRegressor(featuresCol="_vector", labelCol="_y", **(TREES | settings)).fit(shaped.select("_vector", (F.col(t) - start[t]).alias("_y")))
        stages[t] = PipelineModel([feature_vector(features), fitted.setFeaturesCol("features")])
    return OffsetModel(list(features), stages, start)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function by a rational approximation (absolute error below
    4.5e-4)."""
    # Coefficients of the approximation of Abramowitz and Stegun 26.2.23.
    c, d = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2.0 * F.log(F.greatest(tail, F.lit(1e-7))))
    z = t - (c[0] + c[1] * t + c[2] * t * t) / (1 + d[0] * t + d[1] * t * t + d[2] * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


def to_normal(df: DataFrame, cols: Sequence[str], grid: int = 100) -> tuple[DataFrame, dict[str, list[float]]]:
    """Columns mapped through their quantiles to a normal law; the quantile grids are a bounded model."""
    points = [k / grid for k in range(grid + 1)]
    row = df.agg(*(F.percentile_approx(c, points, 10_000).alias(c) for c in cols)).first()
    grids = {c: list(map(float, row[c])) for c in cols}
    return apply_normal(df, grids), grids


def apply_normal(df: DataFrame, grids: Mapping[str, Sequence[float]]) -> DataFrame:
    """Each column's place among its quantiles, by binary search, then the normal quantile of that; two
    projections, so that neither is computed anew wherever its result is used."""
    cells = {c: [(k, a, b) for k, (a, b) in enumerate(zip(g[:-1], g[1:], strict=True)) if b > a] for c, g in grids.items()}
    searched = [c for c in grids if cells[c]]
    if searched:
        splits = [[-math.inf, *(a for _, a, _ in cells[c]), math.inf] for c in searched]
        df = Bucketizer(inputCols=searched, outputCols=[f"_cell_{c}" for c in searched], splitsArray=splits, handleInvalid="keep").transform(df)
    places = {}
    for c, g in grids.items():
        n, value = len(g) - 1, F.col(c)
        k, lo, hi = (F.get(F.array(*(F.lit(float(x)) for x in part)), F.col(f"_cell_{c}").cast("int") - 1) for part in zip(*cells[c], strict=True)) if cells[c] else [None] * 3
        places[f"_at_{c}"] = F.when(value < g[0], 0.0).when(value >= g[-1], 1.0).otherwise((k + (value - lo) / (hi - lo)) / n) if cells[c] else F.when(value.isNotNull(), 0.5)
    placed = df.withColumns(places)
    return placed.withColumns({c: normal_quantile(F.col(f"_at_{c}")) for c in grids}).drop(*places, *(f"_cell_{c}" for c in searched))


@dataclass
class BaggedLinear:
    """Quantile grids of the features, and for each target its bags: features, weights, intercept; and the
    penalty of each bag."""

    grids: dict[str, list[float]]
    models: dict[str, list[tuple[list[str], list[float], float]]]
    penalties: dict[str, list[float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        own = {f: f"_normal_{f}" for f in self.grids}  # the features themselves stay
        out = df.withColumns({n: F.coalesce(F.nanvl(f, F.lit(None).cast("double")), F.lit(0.0)) for f, n in own.items()})
        out = apply_normal(out, {own[f]: g for f, g in self.grids.items()})
        for target, bags in self.models.items():
            total: dict[str, float] = {}  # the mean of linear models is one
            for names, weights, _ in bags:
                for f, w in zip(names, weights, strict=True):
                    total[f] = total.get(f, 0.0) + w / len(bags)
            start = F.lit(sum(c for _, _, c in bags) / len(bags))
            out = out.withColumn(f"predicted_{target}", sum((F.col(own[f]) * w for f, w in total.items() if w), start))
        return out.drop(*own.values())

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a folder, over a model that is there."""
        _note(spark, f"{path}/about", {"grids": self.grids, "models": self.models, "penalties": self.penalties})

    @staticmethod
    def load(spark: SparkSession, path: str) -> BaggedLinear:
        return BaggedLinear(**_noted(spark, f"{path}/about"))


def bagged_lasso(train: DataFrame, features: Sequence[str], keys: Sequence[str], targets: Sequence[str] = OFFSETS, seed: int = 99, alpha: float | None = None, groups: int = 60, folds: int = 3, penalties: int = 100, **settings) -> BaggedLinear:
    """Sparse linear models on shares of the rows and of the features, averaged. Rows fall into hashed
    groups, of which a bag takes a share; its penalty is chosen by folds of its groups, unless `alpha`
    gives one. The rows are read twice: for the quantile grids, and for the statistics of all bags."""
    s = BAGS | settings
    shaped, grids = to_normal(train.fillna(0.0, subset=list(features)).select(*dict.fromkeys([*keys, *features, *targets])), features)
    stats = lasso.group_statistics(shaped, list(features), list(targets), keys, groups, seed)
    models, used = lasso.fit_bags(stats, list(features), list(targets), s["bags"], s["row_share"], s["feature_share"], folds, penalties, alpha, seed)
    return BaggedLinear(grids, models, used)


def predict_sites(model, validation: DataFrame, base: str = "skt", keys: Sequence[str] = ("region", "site", "time"), kelvin: bool = True) -> DataFrame:
    """One row per key: predicted offsets and temperatures."""
    from nivalis.operators.series import add_base

    out = model.transform(validation)
    made = [c for c in out.columns if c.startswith("predicted_")]
    return add_base(out, made, base, kelvin).select(*keys, *made, *(m.removesuffix("_offset") for m in made))


def predict_grid(model, grid: DataFrame, cube: DataFrame, points: DataFrame, year: int, month: int, statics: Sequence[str], dynamics: Sequence[str], max_points: int = 130_000, margin: float = 500.0, base: str = "skt") -> DataFrame:
    """Dense prediction of one month: clip, complete cells, thin, interpolate the lagged coarse fields,
    add cycles, apply the model, add the base back. Cells need lat and lon."""
    from nivalis.functions.timecols import cyclical_features
    from nivalis.operators.interpolate import interp_linear
    from nivalis.operators.select import bbox, clip_to_box, complete_cells, thin_grid
    from nivalis.operators.series import lag_features

    cells = thin_grid(complete_cells(clip_to_box(grid, bbox(points, margin)), list(statics)), max_points)
    lagged = lag_features(cube, list(dynamics), ["lat", "lon"])
    wanted = lagged.filter((F.year("time") == year) & (F.month("time") == month))
    values = [c for c in wanted.columns if c not in ("time", "lat", "lon")]
    places = cells.select("region", "iy", "ix", "lat", "lon").crossJoin(F.broadcast(wanted.select("time").distinct()))  # a month's hours
    fields = interp_linear(places, wanted, values, ["lat", "lon"], ["time"], ["region", "iy", "ix", "time"])
    joined = fields.join(cells, ["region", "iy", "ix"])
    return predict_sites(model, cyclical_features(joined), base, ["region", "iy", "ix", "time"])


def model_for(registry: DataFrame, wanted: DataFrame, seed: int = 5) -> DataFrame:
    """For each wanted (region, year) the model of that year, else one of the region's by hash.
    registry: region, model_year, model."""
    exact = F.when(F.col("model_year") == F.col("year"), 0).otherwise(1)
    order = Window.partitionBy("region", "year").orderBy(exact, F.md5(F.concat_ws("|", "region", "year", "model_year", F.lit(str(seed)))), "model_year")
    return wanted.join(registry, "region").withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def predictor_table(readings: DataFrame, sites: DataFrame, cube: DataFrame, dynamics: Sequence[str], static: Sequence[str], targets: Sequence[str] = ("T1", "T2", "T3"), base: str = "skt") -> tuple[DataFrame, list[str]]:
    """Everything a fit needs, from raw tables: hourly medians of the readings (region, site, time,
    targets), coarse fields (time, lat, lon, dynamics) with their lags interpolated to the sites in
    space and time, static site columns, cycles, and the offsets of the targets from the base field.
    Returns the table and the names of its features."""
    from nivalis.functions.timecols import cyclical_features
    from nivalis.operators.aggregate import hourly_median
    from nivalis.operators.interpolate import interp_trilinear
    from nivalis.operators.series import lag_features, lag_name, temperature_offsets

    hourly = hourly_median(readings, list(targets), ["region", "site"]).join(sites.select("site", *dict.fromkeys(["lat", "lon", *static])), "site")
    hourly = settle(hourly, "hourly")  # read for the times, the places and the rows
    lagged = lag_features(cube.select("time", "lat", "lon", *dynamics), list(dynamics), ["lat", "lon"])
    fields = [c for c in lagged.columns if c not in ("time", "lat", "lon", *dynamics)]
    at = interp_trilinear(hourly.select("site", "time", "lat", "lon").distinct(), lagged, fields)
    tasks = tasks_of(hourly.sparkSession, hourly.count())  # rows of both sides are dealt by their number
    joined = cyclical_features(hourly.repartition(tasks, "site", "time").join(at.repartition(tasks, "site", "time"), ["site", "time"]), ["ann", "diu", "chn"])
    cycles = [c for c in joined.columns if c.startswith("Cycle_")]
    return temperature_offsets(joined, targets, lag_name(base, 0)), [*fields, *static, *cycles]


def held_out_skill(predicted: DataFrame, validation: DataFrame, target: str, base: str, by: Sequence[str] = ("region",), keys: Sequence[str] = ("region", "site", "time"), kelvin: bool = True) -> DataFrame:
    """Correlation and RMSE of a prediction (predicted_<target>) and of the raw base field, per group."""
    both = validation.select(*keys, target, base).join(predicted.select(*keys, f"predicted_{target}"), list(keys))
    return skill_of(both, target, base, by, kelvin)


def skill_of(rows: DataFrame, target: str, base: str, by: Sequence[str] = ("region",), kelvin: bool = True) -> DataFrame:
    """held_out_skill() of rows that have their prediction beside the target and the base field."""
    from nivalis.functions.skill import pearson, rmse

    both = rows.withColumn("_raw", F.col(base) - (273.15 if kelvin else 0.0))
    named = {"fit": f"predicted_{target}", "raw": "_raw"}
    return both.groupBy(*by).agg(
        F.count("*").alias("n"), *(f(target, c).alias(f"{k}_{n}") for n, c in named.items() for k, f in (("corr", pearson), ("rmse", rmse)))
    )


def linear_contributions(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Exact contributions of a linear model: weight times distance from the mean."""
    means = df.agg(*(F.avg(f).alias(f"_m_{f}") for f in weights))
    out = df.crossJoin(F.broadcast(means))
    return out.select(*((F.col(f) - F.col(f"_m_{f}")) * w for f, w in weights.items())).toDF(*weights)


def attribution_rank(contributions: DataFrame) -> DataFrame:
    """Mean size of each feature's contribution, largest first."""
    long = contributions.unpivot([], contributions.columns, "feature", "value")
    return long.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "feature")


def attribution_by_variable(rank: DataFrame) -> DataFrame:
    """Mean importance by class, variable and lag, read off the feature names."""
    f = F.col("feature")
    kind = (
        F.when(f.startswith("Cycle_"), "cycle")
        .when(f.startswith("St_") | f.endswith("static") | f.isin("lat", "lon"), "static")
        .otherwise("dynamic")
    )
    lag = F.when(kind == "dynamic", F.regexp_extract(f, r"_([+-]\d+)$", 1).try_cast("int"))
    variable = F.when(kind == "dynamic", F.regexp_extract(f, r"^E5_(.*)_[+-]\d+$", 1)).when(kind == "cycle", F.regexp_replace(f, "^Cycle_", "")).otherwise(F.regexp_replace(f, "^St_", ""))
    named = rank.select(kind.alias("kind"), variable.alias("variable"), lag.alias("lag"), "importance")
    sets = [[F.col("kind")], [F.col("kind"), F.col("variable")], [F.col("kind"), F.col("lag")]]
    return named.groupingSets(sets, "kind", "variable", "lag").agg(F.avg("importance").alias("importance"), F.count("*").alias("n"))


def partial_dependence(model, sample: DataFrame, feature: str, target: str, grid: int = 50) -> DataFrame:
    """Mean prediction of a bounded sample with one feature set to each of `grid` values."""
    lo, hi = sample.agg(F.min(feature), F.max(feature)).first()
    values = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: F.lit(float(lo)) + k * (float(hi) - float(lo)) / (grid - 1))
    spread = sample.drop(feature).withColumn(feature, F.explode(values))
    return model.transform(spread).groupBy(feature).agg(F.avg(f"predicted_{target}").alias("prediction"))


def pca(df: DataFrame, features: Sequence[str], ncomp: int, fitted: PipelineModel | None = None) -> tuple[DataFrame, PipelineModel]:
    """Means for missing values, centring, components; at most as many as columns."""
    if fitted is None:
        fitted = Pipeline(stages=[
            Imputer(inputCols=list(features), outputCols=[f"_{f}" for f in features]),
            VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
            PCA(k=min(ncomp, len(features)), inputCol="_centred", outputCol="components"),
        ]).fit(df)
    return fitted.transform(df).drop("_raw", "_centred", *(f"_{f}" for f in features)), fitted


def components_of(df: DataFrame, ncomp: int) -> DataFrame:
    """Components as plain columns."""
    return df.withColumns({f"pc{k + 1}": F.get(vector_to_array("components"), k) for k in range(ncomp)}).drop("components")

"""Contributions of features to the predictions of boosted trees, row by row.

A row takes a path through every tree.  What a node expects is the mean of the leaves that the training
rows below it reach: the rows of each leaf are counted, and the counts go up the tree.  At every step of a path the
expectation changes, and the change, times the tree's weight, goes to the feature the node splits on.
The changes along a path add up to its leaf less what the root expects; so a row's contributions and
the base (what the roots expect, and the start value) add up to its prediction.

Trees are a table (tree, weight, node, feature, threshold, left, right, value) with nodes numbered from
0, the root, and a feature of -1 at leaves.  It is as large as the model, and is broadcast as one row.
Rows need all features; those with a missing one have no prediction either."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivalis.plans.modelling import OffsetModel
from nivalis.tables import settle, shared_folder

_NODE = ("node", "feature", "threshold", "left", "right", "value")


def saved_trees(fitted, like: DataFrame) -> tuple[DataFrame, int]:
    """The trees of a fitted model as a table, and the steps that a path takes at most. Only splits by a
    threshold are known."""
    spark = like.sparkSession
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    fitted.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.createDataFrame(list(enumerate(map(float, fitted.treeWeights))), "treeID int, weight double")  # a row a tree
    threshold = F.when(F.col("split.numCategories") == -1, F.get("split.leftCategoriesOrThreshold", F.lit(0)))
    threshold = F.when((F.col("leftChild") >= 0) & threshold.isNull(), F.raise_error(F.lit("a split by categories"))).otherwise(threshold)
    table = nodes.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree"), "weight", F.col("id").alias("node"),
        F.when(F.col("leftChild") >= 0, F.col("split.featureIndex")).otherwise(-1).alias("feature"),
        threshold.alias("threshold"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("value"),
    )
    return settle(table, "trees"), int(fitted.getMaxDepth())


def _one_row(trees: DataFrame) -> DataFrame:
    nodes = F.sort_array(F.collect_list(F.struct(*_NODE))).alias("nodes")
    each = trees.groupBy("tree", "weight").agg(nodes)
    return each.agg(F.sort_array(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("_trees"))


def paths_of(df: DataFrame, features: Sequence[str], trees: DataFrame, depth: int) -> DataFrame:
    """Adds _trees, and _paths: the nodes that the row passes in each of them. Rows with a missing
    feature go."""
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    x = F.array(*(F.col(f).cast("double") for f in features))

    def path(tree: Column) -> Column:
        nodes = tree["nodes"]

        def step(so_far: Column, _) -> Column:
            # of an array of one, so that the node is looked up once for all its fields
            below = F.transform(F.array(F.element_at(so_far, -1)), lambda here: F.get(nodes, F.when(F.get("_x", here["feature"]) <= here["threshold"], here["left"]).otherwise(here["right"])))
            return F.concat(so_far, below)

        passed = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.array(F.get(nodes, F.lit(0))), step)
        return F.transform(F.filter(passed, lambda here: here.isNotNull()), lambda here: here["node"])

    placed = df.filter(known).withColumn("_x", x).crossJoin(F.broadcast(_one_row(trees)))
    return placed.withColumn("_paths", F.transform("_trees", path)).drop("_x")


def leaf_counts(train: DataFrame, features: Sequence[str], trees: DataFrame, depth: int) -> DataFrame:
    """(tree, leaf, n): the rows that end in each leaf."""
    placed = paths_of(train.select(*features), features, trees, depth)
    ends = F.zip_with("_trees", "_paths", lambda tree, path: F.struct(tree["tree"].alias("tree"), F.element_at(path, -1).alias("leaf")))
    return placed.select(F.explode(ends).alias("_e")).groupBy("_e.tree", "_e.leaf").agg(F.count("*").alias("n"))


def fitted_counts(model: PipelineModel, train: DataFrame, trees: DataFrame) -> DataFrame:
    """leaf_counts() by the fitted model itself, which numbers the leaves of a tree from left to right, as
    saved nodes are numbered."""
    shape, fitted = model.stages[0], model.stages[-1].copy()
    made = fitted.setLeafCol("_leaves").transform(shape.transform(train)).select(F.posexplode(vector_to_array("_leaves")).alias("tree", "_k"))
    found = made.groupBy("tree", F.col("_k").cast("int").alias("_k")).agg(F.count("*").alias("n"))
    leaves = trees.filter("feature < 0").withColumn("_k", F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1)
    return leaves.join(found, ["tree", "_k"]).select("tree", F.col("node").alias("leaf"), "n")


def expectations(trees: DataFrame, counts: DataFrame, depth: int) -> DataFrame:
    """The trees, with each node's value replaced by the mean of the leaves that counted rows reach
    through it. Nodes that no row passes keep theirs. All tables are as large as the model."""
    below = trees.select("tree", F.col("node").alias("_end"), F.when(F.col("feature") >= 0, F.array("left", "right")).otherwise(F.array("node")).alias("_next"))
    reached = trees.filter("node = 0").select("tree", F.col("node").alias("_end"), F.array("node").alias("_path"))
    for _ in range(max(1, depth)):
        on = reached.join(below, ["tree", "_end"]).select("tree", F.explode("_next").alias("_end"), "_path")
        reached = on.select("tree", "_end", F.array_union("_path", F.array("_end")).alias("_path"))
    leaves = reached.join(trees.select("tree", F.col("node").alias("_end"), F.col("value").alias("_leaf")), ["tree", "_end"])
    passed = leaves.join(counts.withColumnRenamed("leaf", "_end"), ["tree", "_end"]).select("tree", F.explode("_path").alias("node"), "_leaf", "n")
    means = passed.groupBy("tree", "node").agg((F.sum(F.col("_leaf") * F.col("n")) / F.sum("n")).alias("_mean"))
    value = F.when(F.col("feature") < 0, F.col("value")).otherwise(F.coalesce("_mean", "value"))
    return settle(trees.join(means, ["tree", "node"], "left").withColumn("value", value).drop("_mean"), "expectations")


def with_expectations(train: DataFrame, features: Sequence[str], trees: DataFrame, depth: int) -> DataFrame:
    """The trees, with what each node expects of the training rows."""
    return expectations(trees, leaf_counts(train, features, trees, depth), depth)


def tree_contributions(df: DataFrame, keys: Sequence[str], features: Sequence[str], expected: DataFrame, depth: int, start: float = 0.0) -> DataFrame:
    """(keys, a column for each feature, base) from trees with expectations. Keys name a row."""
    placed = paths_of(df.select(*dict.fromkeys([*keys, *features])), features, expected, depth)

    def steps(tree: Column, path: Column) -> Column:
        at = lambda k: F.get(tree["nodes"], F.get(path, k))
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.size(path) - 1), lambda k: k < F.size(path) - 1),
            lambda k: F.struct(at(k)["feature"].alias("f"), ((at(k + 1)["value"] - at(k)["value"]) * tree["weight"]).alias("d")),
        )

    changes = F.flatten(F.zip_with("_trees", "_paths", steps))
    none = F.struct(F.lit(-1).alias("f"), F.lit(0.0).alias("d"))  # keeps rows that no tree splits
    long = placed.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.explode(F.concat(F.array(none), changes)).alias("_s"))
    wide = long.groupBy(*(f"_key_{k}" for k in keys)).agg(
        *(F.coalesce(F.sum(F.when(F.col("_s.f") == i, F.col("_s.d"))), F.lit(0.0)).alias(f) for i, f in enumerate(features))
    )
    roots = expected.filter("node = 0").agg((F.coalesce(F.sum(F.col("weight") * F.col("value")), F.lit(0.0)) + start).alias("base"))
    return wide.crossJoin(F.broadcast(roots)).select(*(F.col(f"_key_{k}").alias(k if k not in features else f"key_{k}") for k in keys), *features, "base")


def boosted_contributions(model: OffsetModel, target: str, train: DataFrame, df: DataFrame, keys: Sequence[str] = ("region", "site", "time")) -> DataFrame:
    """Contributions to a model's predictions of one target; keys and features have names of their own."""
    trees, depth = saved_trees(model.stages[target].stages[-1], df)
    expected = expectations(trees, fitted_counts(model.stages[target], train, trees), depth)
    return tree_contributions(df, keys, model.features, expected, depth, model.start.get(target, 0.0))

"""Tree ensembles as node arrays, evaluated inside column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.session import clear_staged, staged_path

NODE = (
    "array<array<struct<feature: int, cut: double, left_values: array<double>, "
    "left: int, right: int, value: double>>>"
)


def is_ensemble(model) -> bool:
    return hasattr(model, "treeWeights") and hasattr(model, "trees")


def node_arrays(spark: SparkSession, model) -> DataFrame:
    """One row ``trees``: the nodes of every tree in order of their ids, children by number.

    The nodes come from the model's own stored form. Leaves have -1 as ``left``; a split on a
    category has ``left_values``, one on a number has ``cut`` (up to it goes left).
    """
    path = staged_path(spark, "trees")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    category = F.col("split.numCategories") >= 0
    values = F.col("split.leftCategoriesOrThreshold")
    node = F.struct(
        "id",
        F.col("split.featureIndex").alias("feature"),
        F.when(~category, F.try_element_at(values, F.lit(1))).alias("cut"),
        F.when(category, values).alias("left_values"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("prediction").alias("value"),
    )
    trees = rows.groupBy("treeID").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    bare = F.transform("nodes", lambda n: n.dropFields("id")).alias("nodes")
    ordered = F.sort_array(F.collect_list(F.struct("treeID", bare)))
    whole = trees.agg(F.transform(ordered, lambda t: t["nodes"]).cast(NODE).alias("trees"))
    collected = spark.createDataFrame(whole.collect(), whole.schema)  # no larger than the model itself
    clear_staged(spark, rows)
    return collected


def ensemble_value(model, trees: Column, x: Column) -> Column:
    """Prediction of the ensemble for the input array ``x``: its trees weighted and added up.

    A walk takes as many steps as the deepest tree has levels and stays at a leaf once there.
    """
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    deepest = max((t.depth for t in model.trees), default=0)

    def walked(nodes: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            n = F.get(nodes, at)
            v = F.get(x, n["feature"])
            left = F.when(n["left_values"].isNull(), v <= n["cut"]).otherwise(
                F.array_contains(n["left_values"], v)
            )
            return F.when(n["left"] < 0, at).when(left, n["left"]).otherwise(n["right"])

        if not deepest:
            return F.get(nodes, F.lit(0))["value"]
        end = F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.lit(0), step)
        return F.get(nodes, end)["value"]

    parts = F.zip_with(trees, weights, lambda nodes, w: walked(nodes) * w)
    total = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    averaged = type(model).__name__.startswith("RandomForest")
    return total / float(sum(model.treeWeights)) if averaged else total

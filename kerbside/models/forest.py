"""Which features a forest splits on, and how early."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.session import materialize

TOP_LEVEL = 4

#: Doublings that reach from the deepest possible node of a tree (level 30) to its root.
DOUBLINGS = 5


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``tree, node, left, right, feature, prediction`` of a saved forest; feature is null
    in leaves."""
    data = spark.read.parquet(f"{path.rstrip('/')}/data")
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    return data.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        F.when(inner, n["split"]["featureIndex"]).alias("feature"), n["prediction"].alias("prediction"))


def splits_by_level(nodes: DataFrame, max_level: int | None = None, keys: Sequence[str] = ("tree",)) -> DataFrame:
    """``*keys, feature, level`` of every splitting node, roots at 0; down to ``max_level``
    only if one is given.

    Every node knows a node above it and how far; each round doubles how far that is.
    """
    inner = nodes.filter("feature IS NOT NULL")
    edges = inner.select(*keys, F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("above"))
    known = inner.join(edges, [*keys, "node"], "left").select(
        *keys, "node", "feature", F.coalesce("above", "node").alias("above"),
        F.when(F.col("above").isNull(), 0).otherwise(1).alias("level"))
    for _ in range(DOUBLINGS):
        higher = known.select(*keys, F.col("node").alias("above"), F.col("above").alias("next"), F.col("level").alias("steps"))
        known = materialize(known.join(higher, [*keys, "above"]).select(
            *keys, "node", "feature", F.col("next").alias("above"), (F.col("level") + F.col("steps")).alias("level")), "levels")
    splits = known.select(*keys, "feature", "level")
    return splits if max_level is None else splits.filter(F.col("level") <= max_level)


def top_features(splits: DataFrame, max_level: int = TOP_LEVEL, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct features used down to ``max_level``, in order, per forest named by ``keys``."""
    return splits.filter(F.col("level") <= max_level).select(*keys, "feature").distinct().orderBy(*keys, "feature")


def feature_counts(splits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Uses of a feature per tree and level."""
    return splits.groupBy(*keys, "tree", "level", "feature").agg(F.count("*").alias("uses"))


def importance(splits: DataFrame, n: int | None = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of 2^-level over all uses of a feature, highest first, ties by feature; the ``n``
    highest of each forest named by ``keys``."""
    scores = splits.groupBy(*keys, "feature").agg(F.sum(F.pow(F.lit(2.0), -F.col("level"))).alias("score"))
    if n:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "feature"))
        scores = scores.withColumn("place", place).filter(F.col("place") <= n).drop("place")
    return scores.orderBy(*keys, F.desc("score"), "feature")


def named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Feature indices replaced by names, as the assembler's metadata gives them."""
    return df.withColumn("feature", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("feature") + 1))

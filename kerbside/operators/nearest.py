"""The k nearest points, exactly, by equi-joins on ever finer grid cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.session import materialize

#: A cell is cut into this many along each axis at the next level.
FACTOR = 8


def _cells(df: DataFrame, lat: str, lon: str, size: float, names: tuple[str, str]) -> DataFrame:
    return df.withColumns({n: F.floor(F.col(c) / size).cast("bigint") for n, c in zip(names, (lat, lon), strict=True)})


def _above(cell: str, levels: int) -> Column:
    """The cell that many levels up. Always derived from the finest cell, so that all
    levels agree on what contains what."""
    return F.floor(F.col(cell) / FACTOR ** levels).cast("bigint")


_BOX = ["y_low", "y_high", "x_low", "x_high", "n"]


def _boxes(leaves: DataFrame, keys: Sequence[str], up: int, outer: bool = True) -> DataFrame:
    """Occupied cells ``up`` levels above the finest: the box around their points and how
    many there are, and the cell that contains them."""
    group = {"cy": _above("leaf_y", up), "cx": _above("leaf_x", up)}
    if outer:
        group |= {"py": _above("leaf_y", up + 1), "px": _above("leaf_x", up + 1)}
    return leaves.groupBy(*keys, *[c.alias(n) for n, c in group.items()]).agg(
        F.min("y_low").alias("y_low"), F.max("y_high").alias("y_high"),
        F.min("x_low").alias("x_low"), F.max("x_high").alias("x_high"), F.sum("n").alias("n"))


def _distances(box: Callable[[str], Column]) -> tuple[Column, Column]:
    """Squared distances between which the points of a box lie from the probe."""
    def axis(v: Column, low: Column, high: Column) -> tuple[Column, Column]:
        near = F.greatest(low - v, v - high, F.lit(0.0))
        far = F.greatest(F.abs(v - low), F.abs(high - v))
        return near * near, far * far

    near_y, far_y = axis(F.col("lat"), box("y_low"), box("y_high"))
    near_x, far_x = axis(F.col("lon"), box("x_low"), box("x_high"))
    return (near_y + near_x).alias("near"), (far_y + far_x).alias("far")


def _prune(scored: DataFrame, probe: Sequence[str], k: int, within: float | None) -> DataFrame:
    """Drop cells that cannot hold one of the k nearest points: as many points are sure to
    lie closer than the cell begins."""
    if within is not None:
        scored = scored.filter(F.col("near") <= within * within)
    by_far = W.partitionBy(*probe).orderBy("far")
    everything = by_far.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        scored.withColumn("upto", F.sum("n").over(by_far))
        .withColumn("bound", F.min(F.when(F.col("upto") >= k, F.col("far"))).over(everything))
        .filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound")))
        .select(*probe, "cy", "cx")
    )


def _descend(kept: DataFrame, leaves: DataFrame, keys: Sequence[str], probe: Sequence[str], up: int, k: int) -> DataFrame:
    """Kept cells to the occupied cells inside them, scored.

    A cell's inside travels as one array of at most ``FACTOR`` squared boxes. What k of
    these boxes rule out on their own is dropped before any row is multiplied.
    """
    inside = _boxes(leaves, keys, up).groupBy(*keys, "py", "px").agg(
        F.collect_list(F.struct("cy", "cx", *_BOX)).alias("inside"))
    joined = kept.withColumnsRenamed({"cy": "py", "cx": "px"}).join(inside, [*keys, "py", "px"])
    scored = joined.select(*probe, F.transform("inside", lambda b: F.struct(
        *_distances(lambda c: b[c]), b["cy"].alias("cy"), b["cx"].alias("cx"), b["n"].alias("n"))).alias("inside"))
    kth = F.get(F.array_sort(F.transform("inside", lambda b: b["far"])), F.lit(k - 1))
    return (
        scored.withColumn("kth", kth)
        .select(*probe, F.inline(F.filter(
            "inside", lambda b: F.col("kth").isNull() | (b["near"] <= F.col("kth")))))
    )


def k_nearest(
    probes: DataFrame,
    points: DataFrame,
    k: int,
    size: float,
    depth: int,
    keys: Sequence[str] = (),
    within: float | None = None,
) -> DataFrame:
    """The ``k`` points nearest to each probe, among points with equal ``keys``.

    ``probes`` has ``keys, lat, lon``, one row each. ``points`` has ``keys, id, p_lat, p_lon``
    and may have more columns, which are handed on. The result has the probe's and the
    point's columns, ``d2`` (squared distance) and ``rank``; equal distances rank by id.

    A probe starts with the 3 x 3 cells of ``size`` around it, so points farther than
    ``size`` on an axis are out of sight: choose it wide enough, or ignore results beyond.
    It then descends ``depth`` levels, each an equi-join from kept cells to the occupied
    cells inside them. Cells are pruned by the boxes around their points, so however many
    points share a cell, and however many probes, only a handful of finest cells per
    probe is ever opened; no group's pairs are formed.
    """
    probe = [*keys, "lat", "lon"]
    finest = size / FACTOR ** depth
    placed = materialize(_cells(points, "p_lat", "p_lon", finest, ("leaf_y", "leaf_x")), "points")
    leaves = placed.groupBy(*keys, "leaf_y", "leaf_x").agg(
        F.min("p_lat").alias("y_low"), F.max("p_lat").alias("y_high"),
        F.min("p_lon").alias("x_low"), F.max("p_lon").alias("x_high"), F.count("*").alias("n"))
    leaves = materialize(leaves, "cells")  # read by every level; the points are not

    around = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    kept = (
        _cells(probes.select(*probe), "lat", "lon", finest, ("leaf_y", "leaf_x"))
        .select(*probe, _above("leaf_y", depth).alias("y"), _above("leaf_x", depth).alias("x"), F.inline(around))
        .select(*probe, (F.col("y") + F.col("dy")).alias("cy"), (F.col("x") + F.col("dx")).alias("cx"))
    )
    top = kept.join(_boxes(leaves, keys, depth, outer=False), [*keys, "cy", "cx"])
    near, _ = _distances(F.col)
    sighted = top if within is None else top.filter(near <= within * within)
    kept = sighted.select(*probe, "cy", "cx")
    for up in range(depth - 1, -1, -1):
        kept = _prune(_descend(kept, leaves, keys, probe, up, k), probe, k, within)

    opened = kept.withColumnsRenamed({"cy": "leaf_y", "cx": "leaf_x"}).join(placed, [*keys, "leaf_y", "leaf_x"])
    dy, dx = F.col("p_lat") - F.col("lat"), F.col("p_lon") - F.col("lon")
    first = W.partitionBy(*probe).orderBy("d2", "id")
    return (
        opened.drop("leaf_y", "leaf_x").withColumn("d2", dy * dy + dx * dx)
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    )

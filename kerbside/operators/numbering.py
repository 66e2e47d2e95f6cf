"""Consecutive numbers for the rows of a relation, in an order, without one task that sees all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.session import materialize
from kerbside.sizing import broadcast_if_bounded


def numbered(distinct: DataFrame, at: Sequence[str], name: str) -> DataFrame:
    """``name, *at``: distinct rows numbered from 0 in the order of ``at``.

    Rows are dealt to ranges whose bounds are drawn from themselves, and put in order there;
    what the ranges before hold is added to a row's place in its range. However crowded a
    part of the order is, its rows are numbered in parallel.
    """
    placed = materialize(distinct.select(*at).repartitionByRange(*at).sortWithinPartitions(*at).select(
        "*", F.monotonically_increasing_id().alias("place")), f"{name}-places")
    # The place has the number of the range above its 33 lowest bits.
    placed = placed.select(*at, F.shiftright("place", 33).alias("range"), F.col("place").bitwiseAND((1 << 33) - 1).alias("rank"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranges = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.join(broadcast_if_bounded(starts, ranges), "range").select(
        (F.col("first") + F.col("rank")).cast("int").alias(name), *at)

"""Exact quantiles and moments from value counts, whatever the distribution.

The input is scanned once, into counts of equal values per measure. A mergeable sketch of an
interval's distinct values gives edges that cut it into parts of like size, wherever its
values lie; exact counts of the parts tell which of them hold the wanted ranks; those become
the next intervals, until each is small enough to be put in order. So an outlier costs
nothing, and no task ever orders more than a small interval.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.session import materialize

#: Parts an interval is cut into per round, and the precision of the edges between them.
PARTS, PRECISION = 32, 2000

#: An interval of so many distinct values is put in order.
SMALL = 4096

_INTERVAL = "measure string, low double, high double, before bigint"


def value_counts(long: DataFrame) -> DataFrame:
    """``measure, value, n`` of rows ``measure, value``, written: the one pass over the input."""
    return materialize(long.groupBy("measure", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n")), "value-counts")


def moments(counts: DataFrame) -> DataFrame:
    """``measure, count, mean, std, min, max`` of value counts."""
    n, value = F.col("n"), F.col("value")
    first = counts.groupBy("measure").agg(
        F.sum("n").alias("count"), (F.sum(value * n) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    # one row per measure: the list of measures is part of the plan
    off = counts.join(F.broadcast(first.select("measure", "mean")), "measure").groupBy("measure").agg(
        F.sum((value - F.col("mean")) * (value - F.col("mean")) * n).alias("squares"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1)))
    return first.join(F.broadcast(off), "measure").select("measure", "count", "mean", std.alias("std"), "min", "max")


def _within(counts: DataFrame, intervals: Sequence[tuple]) -> DataFrame:
    """Value counts inside some intervals: at most two per measure and probability."""
    rows = F.broadcast(counts.sparkSession.createDataFrame(list(intervals), _INTERVAL)).alias("i")
    inside = (F.col("c.measure") == F.col("i.measure")) & F.col("c.value").between(F.col("i.low"), F.col("i.high"))
    return counts.alias("c").join(rows, inside).select("c.*", "i.low", "i.before")


def _parts(counts: DataFrame, intervals: Sequence[tuple]) -> dict[tuple, list[tuple]]:
    """Per interval its parts in order: lowest and highest value, distinct values, rows. At
    most ``PARTS`` rows per interval reach the driver."""
    inside = _within(counts, intervals)
    steps = [k / PARTS for k in range(1, PARTS)]
    edges = inside.groupBy("measure", "low").agg(F.percentile_approx("value", steps, PRECISION).alias("edges"))
    placed = inside.join(F.broadcast(edges), ["measure", "low"]).withColumn(
        "part", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    rows = placed.groupBy("measure", "low", "part").agg(
        F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("values"), F.sum("n").alias("n"))
    found: dict[tuple, list[tuple]] = {}
    for r in rows.orderBy("measure", "low", "part").collect():
        found.setdefault((r["measure"], r["low"]), []).append((r["least"], r["most"], r["values"], r["n"]))
    return found


def intervals_of_ranks(counts: DataFrame, ranks: dict[str, Sequence[int]], small: int = SMALL) -> list[tuple]:
    """``measure, low, high, before, positions``: intervals of at most ``small`` distinct values
    that hold the wanted ranks, and how many rows lie below each."""
    spans = {r["measure"]: r for r in counts.groupBy("measure").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("values")).collect()}
    done: list[tuple] = []
    todo = [(m, spans[m]["low"], spans[m]["high"], 0, tuple(p), spans[m]["values"]) for m, p in ranks.items()]
    while todo:
        done += [t[:5] for t in todo if t[5] <= small]
        todo = [t for t in todo if t[5] > small]
        if not todo:
            break
        parts = _parts(counts, [t[:4] for t in todo])
        cut = []
        for measure, low, _, before, positions, _ in todo:
            found = parts[measure, low]
            starts = [before, *accumulate((p[3] for p in found), initial=before)][1:]
            for (least, most, values, n), start in zip(found, starts, strict=False):
                held = tuple(p for p in positions if start <= p < start + n)
                if held:
                    cut.append((measure, least, most, start, held, values))
        todo = cut
    return done


def quantiles(counts: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``measure, probability, quantile`` with linear interpolation, from value counts."""
    totals = {r["measure"]: r["n"] for r in counts.groupBy("measure").agg(F.sum("n").alias("n")).collect()}
    wanted = [(m, float(p), p * (n - 1)) for m, n in totals.items() for p in probabilities]
    ranks: dict[str, set[int]] = {}
    for m, _, rank in wanted:
        ranks.setdefault(m, set()).update((floor(rank), ceil(rank)))
    spark = counts.sparkSession
    intervals = intervals_of_ranks(counts, {m: sorted(r) for m, r in ranks.items()})
    upto = W.partitionBy("measure", "low").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ordered = _within(counts, [i[:4] for i in intervals]).withColumn("past", F.col("before") + F.sum("n").over(upto))
    positions = F.broadcast(spark.createDataFrame(
        [(m, low, p) for m, low, _, _, held, in intervals for p in held], "measure string, low double, position bigint"))
    hits = ordered.join(positions, ["measure", "low"]).filter(
        (F.col("position") < F.col("past")) & (F.col("position") >= F.col("past") - F.col("n"))).select("measure", "position", "value")
    asked = F.broadcast(spark.createDataFrame(
        [(m, p, rank, position) for m, p, rank in wanted for position in {floor(rank), ceil(rank)}],
        "measure string, probability double, rank double, position bigint"))
    low, high, rank = F.min("value"), F.max("value"), F.first("rank")
    return hits.join(asked, ["measure", "position"]).groupBy("measure", "probability").agg(
        (low + (high - low) * (rank - F.floor(rank))).alias("quantile"))

"""Counts, audits and summary statistics of raw tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.functions import timeparts as tp
from kerbside.operators import quantiles

QUARTILES = (0.25, 0.5, 0.75)


def time_histograms(df: DataFrame, time: str) -> DataFrame:
    """``part, value, n`` for year, month, weekday and hour of ``time``, in one pass.

    Rows are counted per distinct combination first, so the four histograms are built
    from that small table instead of from four copies of the input.
    """
    t = F.col(time)
    combos = df.groupBy(F.year(t).alias("year"), F.month(t).alias("month"),
                        tp.weekday_ix(t).alias("weekday"), F.hour(t).alias("hour")).agg(F.count("*").alias("n"))
    parts = F.array(*[
        F.struct(F.lit(p).alias("part"), F.col(p).cast("int").alias("value"))
        for p in ("year", "month", "weekday", "hour")
    ])
    return combos.select("n", F.inline(parts)).groupBy("part", "value").agg(F.sum("n").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, smaller values first among equals."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def odd_distance(distance: Column) -> Column:
    return (distance <= 0) | (distance >= 100)


def distance_outliers(trips: DataFrame) -> DataFrame:
    return value_counts(trips.filter(odd_distance(F.col("Trip_Distance"))), "Trip_Distance")


def outlier_audit(trips: DataFrame) -> DataFrame:
    """Trips failing each data-quality check, all checks in one scan."""
    lon_low, lon_high = geo.LON_RANGE
    lat_low, lat_high = geo.LAT_RANGE

    def outside(c: str, low: float, high: float) -> Column:
        return F.count_if((F.col(c) <= low) | (F.col(c) >= high))

    return trips.agg(
        F.count("*").alias("trips"),
        F.count_if(odd_distance(F.col("Trip_Distance"))).alias("odd_distance"),
        outside("Start_Lon", lon_low, lon_high).alias("start_lon_outside"),
        outside("Start_Lat", lat_low, lat_high).alias("start_lat_outside"),
        outside("End_Lon", lon_low, lon_high).alias("end_lon_outside"),
        outside("End_Lat", lat_low, lat_high).alias("end_lat_outside"),
    )


def events_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("start_date").alias("day")).agg(F.count("guid").alias("n"))


def average_events_per_day(events: DataFrame) -> DataFrame:
    """Mean over the days with at least one event."""
    return events_per_day(events).agg(F.avg("n").alias("events_per_day"))


def events_per_month(events: DataFrame) -> DataFrame:
    start = F.col("start_date")
    return events.groupBy(F.year(start).cast("int").alias("year"), F.month(start).cast("int").alias("month")) \
        .agg(F.count("guid").alias("n"))


def date_slice(df: DataFrame, time: str, first: date, last: date) -> DataFrame:
    """Rows whose day lies in the closed range. Compared on the raw column, so the range
    reaches the scan and partition pruning still works."""
    t = F.col(time)
    return df.filter((t >= F.lit(first).cast("timestamp_ntz")) & (t < F.date_add(F.lit(last), 1).cast("timestamp_ntz")))


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First rows in a fixed order: a top-k, not a sort of everything."""
    return df.orderBy(*order).limit(n)


# ---- summary statistics --------------------------------------------------------------


def _long(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(F.inline(entries)).filter("value IS NOT NULL")


def exact_quantiles(long: DataFrame, probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """``measure, probability, quantile`` with linear interpolation, exact at any size."""
    return quantiles.quantiles(quantiles.value_counts(long), probabilities)


def describe(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per measure: count, mean, std, min, quartiles, max; missing values skipped. The
    input is scanned once."""
    counts = quantiles.value_counts(_long(df, measures))
    named = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    quartiles = quantiles.quantiles(counts, QUARTILES).groupBy("measure").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for p, n in named.items()])
    # one row per measure on both sides
    return quantiles.moments(counts).join(F.broadcast(quartiles), "measure").select(
        "measure", "count", "mean", "std", "min", *named.values(), "max")


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, frames)

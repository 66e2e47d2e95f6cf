"""Trips to district-hour counts, and what is asked of them directly."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.functions import timeparts as tp

COUNTS = ["Pickup_Count", "Dropoff_Count"]
DISTRICT = ["Lat", "Lon"]
FACT_KEY = ["Time", *DISTRICT]


def trip_ends(trips: DataFrame) -> DataFrame:
    """Up to two rows per trip: where and when it began, where and when it ended.

    Each end is judged on its own, so a trip with one bad end still counts at the
    other. Trips with no usable end are filtered before the rows are doubled.
    """
    start_ok = geo.in_bounds(F.col("Start_Lat"), F.col("Start_Lon")) & F.col("Pickup_Time").isNotNull()
    end_ok = geo.in_bounds(F.col("End_Lat"), F.col("End_Lon")) & F.col("Dropoff_Time").isNotNull()
    start = F.struct(
        F.lit(1).alias("is_pickup"), F.col("Pickup_Time").cast("timestamp").alias("t"),
        F.col("Start_Lat").alias("lat"), F.col("Start_Lon").alias("lon"), start_ok.alias("ok"))
    end = F.struct(
        F.lit(0).alias("is_pickup"), F.col("Dropoff_Time").cast("timestamp").alias("t"),
        F.col("End_Lat").alias("lat"), F.col("End_Lon").alias("lon"), end_ok.alias("ok"))
    return (
        trips.filter(start_ok | end_ok)
        .select(F.explode(F.array(start, end)).alias("e"))
        .filter("e.ok")
        .select(
            tp.hour_of(F.col("e.t")).alias("Time"),
            geo.cell_of(F.col("e.lat")).alias("lat_cell"),
            geo.cell_of(F.col("e.lon")).alias("lon_cell"),
            F.col("e.is_pickup").alias("is_pickup"),
        )
    )


def district_hours(trips: DataFrame) -> DataFrame:
    """Pickups and dropoffs per hour and district, 0 where only the other occurs.

    One scan and one shuffle: both counts come out of a single aggregate instead of a
    full outer join of two. Counting combines on the map side, so a hot district costs
    one row per task and hour.
    """
    return (
        trip_ends(trips)
        .groupBy("Time", "lat_cell", "lon_cell")
        .agg(
            F.sum(F.col("is_pickup").cast("bigint")).alias("Pickup_Count"),
            F.sum((1 - F.col("is_pickup")).cast("bigint")).alias("Dropoff_Count"),
        )
        .select(
            "Time",
            geo.degrees_of(F.col("lat_cell")).alias("Lat"),
            geo.degrees_of(F.col("lon_cell")).alias("Lon"),
            *COUNTS,
        )
    )


def top_districts(facts: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` districts with most pickups; ties go to the smaller coordinates."""
    return (
        facts.groupBy(*DISTRICT).agg(F.sum("Pickup_Count").alias("Pickups"))
        .orderBy(F.desc("Pickups"), *DISTRICT).limit(n)
    )


def sample_districts(facts: DataFrame, n: int = 25, among: int = 200, seed: int = 1234) -> DataFrame:
    """``n`` districts drawn uniformly from the ``among`` busiest.

    The order of the draw is a hash of district and seed, so it does not hang on how the
    rows are laid out.
    """
    draw = F.md5(F.concat_ws("|", geo.cell_of(F.col("Lat")), geo.cell_of(F.col("Lon")), F.lit(str(seed))))
    return top_districts(facts, among).orderBy(draw).limit(n).select(*DISTRICT)


def district_rows(features: DataFrame) -> DataFrame:
    """Rows (hours, not trips) per district."""
    return features.groupBy(*DISTRICT).agg(F.count("*").alias("rows"))


def of_districts(df: DataFrame, districts: DataFrame, max_districts: int | None = None) -> DataFrame:
    """Rows of the listed districts, matched on grid cells rather than on doubles."""
    from kerbside.sizing import broadcast_if_bounded

    def keyed(d: DataFrame) -> DataFrame:
        return d.withColumns({"lat_cell": geo.cell_of(F.col("Lat")), "lon_cell": geo.cell_of(F.col("Lon"))})

    keys = keyed(districts).select("lat_cell", "lon_cell").distinct()
    keys = broadcast_if_bounded(keys, max_districts)
    return keyed(df).join(keys, ["lat_cell", "lon_cell"], "left_semi").drop("lat_cell", "lon_cell")


def split_by_time(df: DataFrame, split: datetime, strict_reference: bool = False) -> tuple[DataFrame, DataFrame]:
    """(before, from) the split instant. ``strict_reference`` leaves the very hour of the
    split out of both parts."""
    at = F.to_timestamp(F.lit(split.strftime("%Y-%m-%d %H:%M:%S")))
    later = F.col("Time") > at if strict_reference else F.col("Time") >= at
    return df.filter(F.col("Time") < at), df.filter(later)

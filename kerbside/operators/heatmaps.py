"""Normalised point weights per map frame, and the documents a map page loads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.functions import timeparts as tp
from kerbside.functions.values import score_or_zero
from kerbside.sources.tables import INDEX_PART

POINT_RADIUS = 10  # Fixed value of the document format.
#: Points of a document: a frame with more is cut into parts.
PART_POINTS = 250_000
#: Parts are made of whole squares of a quarter degree, at most 250 x 250 cells of a thousandth.
SQUARE_CELLS = 250


def _cells(df: DataFrame, lat: str, lon: str) -> DataFrame:
    d = geo.HEATMAP_DECIMALS
    return df.withColumns({"lat_cell": geo.cell_of(F.col(lat), d), "lon_cell": geo.cell_of(F.col(lon), d)})


def pickup_points(trips: DataFrame) -> DataFrame:
    """Pickups inside the bounding box with their fine grid cell."""
    inside = trips.filter(geo.in_bounds(F.col("Start_Lat"), F.col("Start_Lon")))
    return _cells(inside, "Start_Lat", "Start_Lon").withColumn("Time", F.col("Pickup_Time").cast("timestamp"))


def event_points(events: DataFrame) -> DataFrame:
    """Located events with score and fine grid cell; maps of events have no bounding box."""
    located = events.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return _cells(located, "latitude", "longitude").select(
        "lat_cell", "lon_cell", F.col("start_date").cast("timestamp").alias("Time"),
        score_or_zero(F.col("score")).alias("score"))


def frame_whole(_: Column) -> Column:
    return F.lit(0)


def frame_weekday(t: Column) -> Column:
    return tp.weekday_ix(t)


def frame_hour(t: Column) -> Column:
    return F.hour(t).cast("int")


def _weighted(sums: DataFrame, value: str, offset: float) -> DataFrame:
    """Weights relative to the largest sum over all frames, so frames can be compared.

    The maximum is a scalar subquery over the same aggregate, whose shuffle is shared.
    """
    top = sums.agg(F.max(value)).scalar()
    d = geo.HEATMAP_DECIMALS
    return sums.select(
        "frame", geo.degrees_of(F.col("lat_cell"), d).alias("lat"), geo.degrees_of(F.col("lon_cell"), d).alias("lon"),
        value, (F.col(value).cast("double") / top + offset).alias("weight"))


def pickup_heatmap(points: DataFrame, frame=frame_whole) -> DataFrame:
    """``frame, lat, lon, pickups, weight`` with weight = pickups / maximum."""
    sums = points.groupBy(frame(F.col("Time")).alias("frame"), "lat_cell", "lon_cell") \
        .agg(F.count("*").alias("pickups"))
    return _weighted(sums, "pickups", 0.0)


def event_heatmap(points: DataFrame, frame=frame_whole) -> DataFrame:
    """``frame, lat, lon, score, weight`` with weight = summed score / maximum + 1."""
    sums = points.groupBy(frame(F.col("Time")).alias("frame"), "lat_cell", "lon_cell") \
        .agg(F.sum("score").alias("score"))
    return _weighted(sums, "score", 1.0)


def same_hour_days(points: DataFrame, days: list[date], hour: int) -> DataFrame:
    """Pickups of one hour on the listed days; the frame is the day's position in the list."""
    day = F.to_date("Time")
    position = F.array_position(F.array(*[F.lit(d) for d in days]), day) - 1
    chosen = points.filter(day.isin(*days) & (F.hour("Time") == hour))
    sums = chosen.groupBy(position.cast("int").alias("frame"), "lat_cell", "lon_cell") \
        .agg(F.count("*").alias("pickups"))
    return _weighted(sums, "pickups", 0.0)


def weekday_slice(points: DataFrame, weekday: int, hour: int) -> DataFrame:
    """Rows of one hour on one weekday, framed by day of the year."""
    t = F.col("Time")
    chosen = points.filter((tp.weekday_ix(t) == weekday) & (F.hour(t) == hour))
    sums = chosen.groupBy(F.dayofyear(t).cast("int").alias("frame"), "lat_cell", "lon_cell") \
        .agg(F.count("*").alias("pickups"))
    return _weighted(sums, "pickups", 0.0)


def weekday_frames(spark: SparkSession) -> DataFrame:
    ix = F.col("id").cast("int")
    return spark.range(7).select(ix.alias("frame"), tp.weekday_label(ix).alias("title"),
                                 ix.cast("string").alias("name"))


def hour_frames(spark: SparkSession) -> DataFrame:
    ix = F.col("id").cast("int")
    return spark.range(24).select(ix.alias("frame"), tp.hour_label(ix).alias("title"),
                                  F.format_string("%02d", ix).alias("name"))


def single_frame(spark: SparkSession, title: str, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("frame"), F.lit(title).alias("title"), F.lit(name).alias("name"))


def listed_frames(spark: SparkSession, titles: list[str]) -> DataFrame:
    labels = F.array(*[F.lit(t) for t in titles])
    ix = F.col("id").cast("int")
    return spark.range(len(titles)).select(ix.alias("frame"), F.element_at(labels, ix + 1).alias("title"),
                                           F.format_string("%02d", ix).alias("name"))


def documents(weights: DataFrame, frames: DataFrame, part_points: int = PART_POINTS) -> DataFrame:
    """``name, part, document``: JSON documents ``{title, pointRadius, data}`` per frame, and one
    index per frame, ``{title, pointRadius, points, parts}``, whose ``part`` is ``index``.

    A frame of at most ``part_points`` points is one document, wherever its points lie; without
    points its data is empty. Of a larger one whole squares, in their order, make up parts that
    end with the square that fills them, so a part's size is bounded by the two constants.
    Only counts per square are put in order; points go straight to their part.
    """
    d = geo.HEATMAP_DECIMALS
    axes = {"lat_square": "lat", "lon_square": "lon"}
    placed = weights.withColumns({s: F.floor(geo.cell_of(F.col(c), d) / SQUARE_CELLS).cast("int") for s, c in axes.items()})
    squares = placed.groupBy("frame", *axes).agg(F.count("*").alias("points"))
    # a frame has no more squares than the globe, 1440 x 720
    before = W.partitionBy("frame").orderBy(*axes).rowsBetween(W.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("points").over(before), F.lit(0)) / part_points).cast("int")
    whole = F.sum("points").over(W.partitionBy("frame")) <= part_points
    numbered = squares.select("frame", *axes, "points", F.when(whole, 0).otherwise(part).alias("part_id"))
    point = F.struct("lat", "lon", "weight")
    parts = placed.join(numbered.drop("points"), ["frame", *axes]).groupBy("frame", "part_id") \
        .agg(F.array_sort(F.collect_list(point)).alias("data"))
    head = [F.col("title"), F.lit(POINT_RADIUS).alias("pointRadius")]
    nothing = F.array().cast("array<struct<lat:double,lon:double,weight:double>>")
    name_of = F.coalesce(F.col("part_id"), F.lit(0)).cast("string")
    pieces = frames.join(parts, "frame", "left").select(
        "name", name_of.alias("part"),
        F.to_json(F.struct(*head, F.coalesce("data", nothing).alias("data"))).alias("document"))
    listed = frames.join(numbered, "frame", "left").groupBy("name", "title").agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.array_sort(F.collect_set(name_of)).alias("parts"))
    index = listed.select(
        "name", F.lit(INDEX_PART).alias("part"), F.to_json(F.struct(*head, "points", "parts")).alias("document"))
    return pieces.unionByName(index)


def map_series(
    spark: SparkSession, pickups: DataFrame | None, events: DataFrame | None, days: list[date], hour: int,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """``name -> (weights, frames)`` of every published series: pickups in all, by weekday, by hour
    and on equal hours of the listed days, and events in all, by weekday and by hour."""
    framings = {"": (frame_whole, None), "_by_weekday": (frame_weekday, weekday_frames(spark)), "_by_hour": (frame_hour, hour_frames(spark))}
    series = {}
    for kind, points, weigh in (("pickups", pickups, pickup_heatmap), ("events", events, event_heatmap)):
        if points is not None:
            for suffix, (frame, frames) in framings.items():
                listed = frames if frames is not None else single_frame(spark, kind.capitalize(), kind)
                series[kind + suffix] = (weigh(points, frame), listed)
    if pickups is not None and days:
        titles = [f"{d.isoformat()} {hour:02d}:00" for d in days]
        series["pickups_same_hour"] = (same_hour_days(pickups, days, hour), listed_frames(spark, titles))
    return series

"""Intermediate and result tables: facts, features, districts, predictions, errors, maps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geo

#: Separator of prediction and error files.
PAIR_SEPARATOR = ", "

#: Columns of the directories of a table stored by month.
MONTH_PARTS = ("in_year", "in_month")


def write_by_month(df: DataFrame, path: str, time: str = "Time") -> None:
    """Parquet with one directory per month, which ``read_by_month`` prunes by time.

    Rows are rebalanced by month: few files each, and a month that holds a third of the
    rows is split between tasks. The directories' columns have names of their own, so that
    features called ``Month`` or ``Year`` survive.
    """
    parts = dict(zip(MONTH_PARTS, (F.year(time), F.month(time)), strict=True))
    df.withColumns(parts).hint("rebalance", *parts).write.partitionBy(*parts).parquet(path)


def read_by_month(
    spark: SparkSession, path: str, first: datetime | None = None, last: datetime | None = None, time: str = "Time",
) -> DataFrame:
    """The rows from ``first`` to ``last`` inclusive, from the directories of these months alone."""
    rows = spark.read.parquet(path)
    at = F.col(MONTH_PARTS[0]) * 12 + F.col(MONTH_PARTS[1])
    if first is not None:
        rows = rows.filter((at >= first.year * 12 + first.month) & (F.col(time) >= F.lit(first)))
    if last is not None:
        rows = rows.filter((at <= last.year * 12 + last.month) & (F.col(time) <= F.lit(last)))
    return rows.drop(*MONTH_PARTS)


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    """``Lat, Lon`` of a list of ``lat,lon`` lines."""
    return spark.read.schema("Lat double, Lon double").option("ignoreLeadingWhiteSpace", True) \
        .option("ignoreTrailingWhiteSpace", True).csv(path)


def district_list(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """The same as a driver-side list: one model is trained per entry."""
    return [(r.Lat, r.Lon) for r in read_districts(spark, path).collect()]


def write_districts(districts: DataFrame, path: str) -> None:
    districts.select("Lat", "Lon").write.csv(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """``time, prediction, label`` files in one directory per district."""
    cells = {"lat_cell": geo.cell_of(F.col("Lat")), "lon_cell": geo.cell_of(F.col("Lon"))}
    (
        scored.withColumns(cells)
        .select(F.date_format("Time", "yyyy-MM-dd HH:mm:ss").alias("time"), "prediction", "label", *cells)
        .hint("rebalance", *cells)
        .write.partitionBy(*cells).option("header", True).option("sep", PAIR_SEPARATOR).csv(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``Time, Lat, Lon, prediction, label``; the district comes from the directory."""
    raw = (
        spark.read.schema("time string, prediction double, label double, lat_cell int, lon_cell int")
        .option("header", True).option("enforceSchema", True).option("sep", PAIR_SEPARATOR).csv(path)
    )
    return raw.select(
        F.to_timestamp("time", "yyyy-MM-dd HH:mm:ss").alias("Time"),
        geo.degrees_of(F.col("lat_cell")).alias("Lat"), geo.degrees_of(F.col("lon_cell")).alias("Lon"),
        "prediction", "label")


ERROR_COLUMNS = ["lat", "lon", "mse", "rmse", "mspe", "rmspe", "mpe"]


def write_errors(errors: DataFrame, path: str) -> None:
    errors.select(*[F.col(c).alias(c) for c in ERROR_COLUMNS]) \
        .write.option("header", True).option("sep", PAIR_SEPARATOR).csv(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} double" for c in ERROR_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True) \
        .option("sep", PAIR_SEPARATOR).csv(path).withColumnsRenamed({"lat": "Lat", "lon": "Lon"})


#: Part that lists the parts of a frame.
INDEX_PART = "index"


def write_documents(documents: DataFrame, path: str) -> None:
    """Heatmap documents as text, one directory per frame and part, the index among them."""
    documents.select("name", "part", "document").write.partitionBy("name", "part").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Points of written documents: ``name, title, point_radius, lat, lon, weight``; frames
    without points keep one row with null coordinates.

    A frame is what its index lists: other parts that lie there are not read, and a missing
    part, or one with too few points, is an error.
    """
    schema = "title string, pointRadius int, points bigint, parts array<string>, data array<struct<lat:double,lon:double,weight:double>>"
    raw = spark.read.schema("value string, name string, part string").text(path)
    doc = raw.select("name", "part", F.from_json("value", schema).alias("d"))
    index = doc.filter(F.col("part") == INDEX_PART).select(
        "name", F.col("d.title").alias("title"), F.col("d.pointRadius").alias("point_radius"),
        F.col("d.points").alias("points"), F.explode("d.parts").alias("part"))
    pieces = doc.filter(F.col("part") != INDEX_PART).select("name", "part", F.col("d.data").alias("data"))
    found = index.join(pieces, ["name", "part"], "left")
    held = found.groupBy("name").agg(F.sum(F.size("data")).alias("held"), F.count_if(F.col("data").isNull()).alias("lost"))
    checked = found.join(held, "name").withColumn("data", F.when(
        (F.col("lost") > 0) | (F.col("held") != F.col("points")),
        F.raise_error(F.concat(F.lit("map documents: parts of frame "), "name", F.lit(" are missing")))).otherwise(F.col("data")))
    return checked.select("name", "title", "point_radius", F.explode_outer("data").alias("p")).select(
        "name", "title", "point_radius", "p.lat", "p.lon", "p.weight")

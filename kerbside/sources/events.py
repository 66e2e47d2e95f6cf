"""Crawled event and venue documents, and the flat event files made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.timeparts import iso_prefix
from kerbside.functions.values import number_or_null

EVENT_SCHEMA = """
    id string, guid string, startDate string, endDate string, allDay boolean, canceled boolean,
    address string, geometry array<struct<lat:double,lng:double>>,
    venue struct<id:string,score:double>
"""
VENUE_SCHEMA = "id string, score double, location struct<lat:double,lon:double>"
GEOCODE_SCHEMA = "address string, lat double, lng double"
FLAT_COLUMNS = ["id", "guid", "start_date", "end_date", "all_day", "score", "latitude", "longitude"]


def _read_json(spark: SparkSession, path: str, schema: str, array_file: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


def read_events(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """Events of JSON array files; ``array_file=False`` reads one document per line, which
    unlike an array file can be split between tasks."""
    return _read_json(spark, path, EVENT_SCHEMA, array_file)


def read_venues(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    return _read_json(spark, path, VENUE_SCHEMA, array_file)


def read_geocodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEOCODE_SCHEMA).option("header", True).csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """Annotated events, one document per line."""
    events.write.json(path)


def write_event_arrays(events: DataFrame, path: str, per_file: int = 500) -> None:
    """Annotated events as files that each hold one array of at most ``per_file`` documents, as a
    crawler leaves them page by page. A file's documents are gathered, so their number bounds a row."""
    numbered = events.select(F.struct(*events.columns).alias("event")) \
        .withColumn("page", F.expr(f"monotonically_increasing_id() div {per_file}"))
    pages = numbered.groupBy("page").agg(F.collect_list("event").alias("events"))
    pages.select("page", F.to_json("events").alias("value")).write.partitionBy("page").text(path)


def write_flat(flat: DataFrame, path: str) -> None:
    flat.select(*FLAT_COLUMNS).write.option("header", True).csv(path)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """Flat events with parsed times; coordinates and scores that are no numbers are null."""
    fields = ", ".join(f"{c} string" for c in FLAT_COLUMNS)
    raw = spark.read.schema(fields).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(
        "id", "guid", iso_prefix(F.col("start_date")).alias("start_date"),
        iso_prefix(F.col("end_date")).alias("end_date"),
        F.col("all_day").try_cast("boolean").alias("all_day"),
        *[number_or_null(F.col(c)).alias(c) for c in ("score", "latitude", "longitude")])

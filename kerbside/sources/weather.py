"""Daily station summaries and hourly precipitation as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.timeparts import compact_date, compact_minute
from kerbside.functions.values import sentinel_to_null
from kerbside.operators.weather import MEASURES

# Numeric columns of the daily summaries.
DAILY_MEASURES = ["PRCP", "SNWD", "SNOW", "PSUN", "TSUN", "TMAX", "TMIN", "TOBS", "AWND"]


def clean_daily(raw: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """``Date, Lat, Lon, Station, measures`` with missing values as null."""
    return raw.select(
        compact_date(F.col("DATE")).alias("Date"),
        F.col("LATITUDE").cast("double").alias("Lat"), F.col("LONGITUDE").cast("double").alias("Lon"),
        F.col("STATION").alias("Station"),
        *[sentinel_to_null(F.col(m)).alias(m) for m in measures])


def read_daily(spark: SparkSession, path: str, header: Sequence[str],
               measures: Sequence[str] = MEASURES) -> DataFrame:
    """Daily summaries. ``header`` names the file's columns in order; only those used are
    parsed, and none is inferred."""
    numeric = set(DAILY_MEASURES) | {"LATITUDE", "LONGITUDE", "ELEVATION"}
    fields = ", ".join(f"`{c}` {'double' if c in numeric else 'string'}" for c in header)
    raw = spark.read.schema(fields).option("header", True).option("enforceSchema", True).csv(path)
    return clean_daily(raw, measures)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: reads one line."""
    line = spark.read.option("header", False).csv(path).limit(1).collect()[0]
    return [str(c).strip() for c in line]


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """``Station, Time, HPCP`` of an hourly precipitation file."""
    raw = (
        spark.read.schema("STATION string, DATE string, HPCP double")
        .option("header", True).option("enforceSchema", True).csv(path)
    )
    return raw.select(F.col("STATION").alias("Station"), compact_minute(F.col("DATE")).alias("Time"),
                      sentinel_to_null(F.col("HPCP")).alias("HPCP"))

"""The pipeline's inputs derived from the supplied test tables.

Trips come from ``events``, weather observations from ``lineitem``, flat city events from
``orders``, crawled documents from ``customer``, ``supplier`` and ``nation``. Every row of
a table becomes a row here. ``oracle.py`` states the same derivations in SQL.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.timeparts import HourRange
from kerbside.functions.values import sentinel_to_null
from kerbside.operators.weather import MEASURES
from kerbside.session import pin

FIRST_DAY = date(2024, 1, 1)
CALENDAR = HourRange(datetime(2024, 1, 1, 0), datetime(2024, 1, 30, 23))
SPLIT = datetime(2024, 1, 24)
STATIONS = 11
GEOMETRY = "array<struct<lat:double,lng:double>>"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _thousandth(base: int, *terms: Column) -> Column:
    total = F.lit(base).cast("bigint")
    for t in terms:
        total = total + t
    return total / F.lit(1000.0)


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """One trip per event, some with one end at 0/0."""
    e = table(spark, sf, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    third, sixth = F.expr("user_id div 3") % 3, F.expr("event_id div 3") % 3
    minutes = F.floor("value").cast("bigint")
    pickup = F.col("ts").cast("timestamp")
    return e.select(
        "event_id",
        pickup.alias("Pickup_Time"),
        (pickup + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).alias("Dropoff_Time"),
        (uid % 7).cast("int").alias("Passenger_Count"),
        (minutes * 3 - 2).cast("double").alias("Trip_Distance"),
        _thousandth(-74000, third * 10, eid % 3).alias("Start_Lon"),
        F.when(eid % 17 == 0, 0.0).otherwise(_thousandth(40700, uid % 3 * 10, eid % 5)).alias("Start_Lat"),
        _thousandth(-74000, sixth * 10, uid % 4).alias("End_Lon"),
        F.when(eid % 19 == 0, 0.0).otherwise(_thousandth(40700, eid % 3 * 10, uid % 5)).alias("End_Lat"),
    )


def weather_raw(spark: SparkSession, sf: str, folded: bool = True) -> DataFrame:
    """Observations as a station file has them, but for the date: -9999 marks a missing value.

    ``folded`` lays the ship dates over the 30 days that the trips cover.
    """
    li = table(spark, sf, "lineitem")
    shipped = F.to_date("l_shipdate")
    day = F.date_add(F.lit(FIRST_DAY), F.datediff(shipped, F.lit(date(1995, 1, 1))) % 30) if folded else shipped
    rows = li.select(
        day.alias("d"), (F.col("l_suppkey") % STATIONS).cast("int").alias("st"),
        "l_quantity", "l_partkey", "l_orderkey", "l_linenumber")
    dom, st, missing = F.dayofmonth("d"), F.col("st"), F.lit(-9999.0)

    def unless(cond: Column, value: Column) -> Column:
        return F.when(cond, missing).otherwise(value.cast("double"))

    return rows.select(
        F.col("d").alias("DATE"),
        (st * 7 % STATIONS).cast("double").alias("LATITUDE"), (st * 3 % STATIONS).cast("double").alias("LONGITUDE"),
        F.concat(F.lit("S"), F.lpad(st.cast("string"), 2, "0")).alias("STATION"),
        unless(dom == 7, F.col("l_partkey") % 40 - F.col("l_orderkey") % 10).alias("TMIN"),
        unless((dom * 3 + st) % 4 == 0, F.col("l_partkey") % 40).alias("TMAX"),
        unless((dom * 7 + st) % 5 == 0, F.col("l_quantity")).alias("PRCP"),
        unless(((dom + st) % 2 == 0) | (st == 3), F.col("l_linenumber")).alias("AWND"),
    )


def observations(spark: SparkSession, sf: str, folded: bool = True) -> DataFrame:
    """``Date, Lat, Lon, Station`` and the four measures, missing values as null."""
    return weather_raw(spark, sf, folded).select(
        F.col("DATE").alias("Date"), F.col("LATITUDE").alias("Lat"),
        F.col("LONGITUDE").alias("Lon"), F.col("STATION").alias("Station"),
        *[sentinel_to_null(F.col(m)).alias(m) for m in MEASURES])


def daily_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """All nine daily measures, missing values as null."""
    part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    measures = {
        "PRCP": (line == 7, F.col("l_quantity")), "SNWD": (part % 5 == 0, F.col("l_extendedprice")),
        "SNOW": (part % 3 == 0, F.col("l_extendedprice") * F.col("l_tax")), "PSUN": (order % 4 == 0, order % 101),
        "TSUN": (order % 6 == 0, order % 1441), "TMAX": (part % 8 == 0, part % 40),
        "TMIN": (part % 9 == 0, part % 40 - order % 10), "TOBS": (line == 3, part % 40 - line), "AWND": (line == 1, F.col("l_discount"))}
    raw = table(spark, sf, "lineitem").select(*[
        F.when(missing, -9999.0).otherwise(value.cast("double")).alias(m) for m, (missing, value) in measures.items()])
    return raw.select(*[sentinel_to_null(F.col(m)).alias(m) for m in measures])


def hourly_precipitation(spark: SparkSession, sf: str) -> DataFrame:
    """``HPCP`` of hourly measurements, missing values as null."""
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        F.when(key % 5 == 0, -9999.0).otherwise((F.col("o_totalprice") * (key % 3)).cast("double")).alias("HPCP"))
    return raw.select(sentinel_to_null(F.col("HPCP")).alias("HPCP"))


def city_events(spark: SparkSession, sf: str) -> DataFrame:
    """Flat events at twenty venues; some without a location, some without a venue score."""
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit(date(1995, 1, 1))) % 30
    start = CALENDAR.start + F.make_dt_interval(day.cast("int"), (key % 24).cast("int"), F.lit(17))
    end = start + F.make_dt_interval(F.lit(0), (cust % 4).cast("int"))
    venue = cust % 20
    unplaced = key % 101 == 0
    return o.select(
        key.alias("id"), F.concat(F.lit("g"), key).alias("guid"),
        start.alias("start_date"), end.alias("end_date"), (cust % 4 == 3).alias("all_day"),
        F.when(cust % 7 == 0, -1.0).otherwise((key % 10).cast("double")).alias("score"),
        F.when(~unplaced, _thousandth(40700, venue % 5 * 10)).alias("latitude"),
        F.when(~unplaced, _thousandth(-74000, F.expr("(o_custkey % 20) div 5") * 10)).alias("longitude"),
    )


def hourly_series(spark: SparkSession, sf: str) -> DataFrame:
    """Hours with a measurement, 1995 to 2001: far from every hour has one."""
    o = table(spark, sf, "orders")
    return o.select((F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(
        F.lit(0), (F.col("o_orderkey") % 24).cast("int"))).alias("Time"))


def _micro(base: int, steps: Column) -> Column:
    return (F.lit(base).cast("bigint") + steps * 10) / F.lit(1000000.0)


def crawled_events(spark: SparkSession, sf: str) -> DataFrame:
    """Nested events; neighbours in the key share a location, every fifth has an address only."""
    c = table(spark, sf, "customer").join(
        F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    pair = F.expr("c_custkey div 2")
    at = F.struct(_micro(40700000, pair * 6151 % 3000).alias("lat"), _micro(-74000000, pair * 3571 % 3000).alias("lng"))
    none = F.lit(None).cast(GEOMETRY)
    return c.select(
        key.cast("string").alias("id"), F.concat(F.lit("g"), key).alias("guid"),
        F.date_format(CALENDAR.start + F.make_dt_interval((key % 30).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
        .alias("startDate"),
        F.when(key % 3 != 0, F.date_format(
            CALENDAR.start + F.make_dt_interval((key % 30).cast("int"), F.lit(2)), "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("endDate"),
        (key % 2 == 0).alias("allDay"), F.when(key % 13 != 0, key % 11 == 0).alias("canceled"),
        F.col("n_name").alias("address"),
        F.when(key % 5 == 0, none).when(key % 7 == 0, F.array().cast(GEOMETRY)).otherwise(F.array(at)).alias("geometry"),
    )


def crawled_venues(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    place = F.struct(_micro(40700000, key * 7919 % 3000).alias("lat"), _micro(-74000000, key * 4523 % 3000).alias("lon"))
    return s.select(
        F.format_string("V%09d", key).alias("id"), (key % 10).cast("double").alias("score"),
        F.when(key % 29 != 0, place).alias("location"))


def geocodes(spark: SparkSession, sf: str) -> DataFrame:
    """What a geocoder gave per address: for some it found no location."""
    n = table(spark, sf, "nation")
    key, found = F.col("n_nationkey").cast("bigint"), F.col("n_regionkey") != 2
    return n.select(
        F.col("n_name").alias("address"),
        F.when(found, _micro(40700000, key * 7919 % 3000)).alias("lat"),
        F.when(found, _micro(-74000000, key * 4523 % 3000)).alias("lng"))

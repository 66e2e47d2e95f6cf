"""Events to venue activity per hour, and the hours around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import timeparts as tp
from kerbside.operators.numbering import numbered

#: Column order of the venue features; it fixes the feature indices of a model.
OFFSETS = (0, -3, -2, -1, 1, 2, 3)
LONGEST_OFFSET = 3


def offset_column(i: int) -> str:
    """``Venues_{i}h`` holds the events at Time - i: a negative i looks ahead."""
    return f"Venues_{i}h"


def event_spans(events: DataFrame) -> DataFrame:
    """``latitude, longitude, start_date, end_date, n``: located events counted per place and
    span of whole hours.

    The one pass over the events. A hot place shrinks to its distinct spans here, before
    anything is joined or expanded.
    """
    return (
        events.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
        .groupBy("latitude", "longitude", tp.hour_of(F.col("start_date")).alias("start_date"),
                 tp.hour_of(F.col("end_date")).alias("end_date"))
        .agg(F.count("*").alias("n"))
    )


def venue_ids(places: DataFrame) -> DataFrame:
    """``venue_id, latitude, longitude``: distinct coordinates numbered by (latitude, longitude),
    in parallel however crowded a strip of the map is."""
    distinct = places.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("latitude", "longitude").distinct()
    return numbered(distinct, ["latitude", "longitude"], "venue_id")


def event_hours(events: DataFrame, calendar: tp.HourRange | None = None) -> DataFrame:
    """One row per event and hour from the first to the last hour, both inclusive.

    Events ending before they start yield nothing. With a calendar the hours outside it
    are never generated.
    """
    first, last = tp.hour_of(F.col("start_date")), tp.hour_of(F.col("end_date"))
    if calendar is not None:
        first, last = F.greatest(first, calendar.start), F.least(last, calendar.end)
    spans = events.withColumns({"first_hour": first, "last_hour": last}).filter("first_hour <= last_hour")
    hours = F.sequence("first_hour", "last_hour", F.expr("INTERVAL 1 HOUR"))
    return spans.withColumn("Time", F.explode(hours)).drop("first_hour", "last_hour")


def venue_hours(spans: DataFrame, venues: DataFrame, calendar: tp.HourRange | None = None) -> DataFrame:
    """``Time, venue_id, n``: events taking place per hour and venue."""
    placed = spans.join(venues, ["latitude", "longitude"])
    return event_hours(placed, calendar).groupBy("Time", "venue_id").agg(F.sum("n").alias("n"))


def dense_venue_hours(activity: DataFrame, calendar: tp.HourRange) -> DataFrame:
    """``Time, Venues``: every calendar hour with its active venues, an empty list if none.

    ``Venues`` is an array of ``(venue_id, n)`` sorted by venue, the sparse vector's
    content; it cannot be longer than the list of venues.
    """
    entries = F.array_sort(F.collect_list(F.struct("venue_id", "n")))
    per_hour = activity.groupBy("Time").agg(entries.alias("Venues"))
    return _on_calendar(per_hour, calendar, ["Venues"])


def _on_calendar(per_hour: DataFrame, calendar: tp.HourRange, columns: Sequence[str]) -> DataFrame:
    nothing = F.array().cast("array<struct<venue_id:int,n:bigint>>")
    return (
        calendar.table(per_hour.sparkSession).join(per_hour, "Time", "left")
        .select("Time", *[F.coalesce(F.col(f"`{c}`"), nothing).alias(c) for c in columns])
    )


def shifted_activity(activity: DataFrame, offsets: Sequence[int] = OFFSETS) -> DataFrame:
    """Long form of the venue features: ``Time, venue_id`` and a count per offset.

    Each (hour, venue) row is handed to the hours that look at it, then summed: one
    shuffle for all offsets.
    """
    at = F.explode(F.array(*[F.lit(i) for i in offsets])).alias("offset")
    moved = activity.select("*", at).withColumn("Time", _moved(F.col("Time"), F.col("offset")))
    return moved.groupBy("Time", "venue_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("offset") == i, F.col("n"))), F.lit(0)).alias(offset_column(i))
        for i in offsets
    ])


def _moved(t: Column, offset: Column) -> Column:
    return t + F.make_dt_interval(F.lit(0), offset)


def venue_features(
    activity: DataFrame, calendar: tp.HourRange, offsets: Sequence[int] = OFFSETS
) -> DataFrame:
    """``Time`` and one list of active venues per offset.

    An hour's list is gathered once; whole lists then go to the hours that look at them.
    Only hours whose neighbours at every offset lie in the calendar are kept, so its
    first and last three hours drop out.
    """
    entries = F.array_sort(F.collect_list(F.struct("venue_id", "n")))
    per_hour = activity.groupBy("Time").agg(entries.alias("Venues"))
    at = F.explode(F.array(*[F.lit(i) for i in offsets])).alias("offset")
    moved = per_hour.select("*", at).withColumn("Time", _moved(F.col("Time"), F.col("offset")))
    shifted = moved.groupBy("Time").agg(*[
        F.first(F.when(F.col("offset") == i, F.col("Venues")), ignorenulls=True).alias(offset_column(i)) for i in offsets])
    names = [offset_column(i) for i in offsets]
    ahead, behind = max(0, -min(offsets)), max(0, max(offsets))
    inside = F.col("Time").between(
        tp.plus_hours(calendar.start, behind), tp.plus_hours(calendar.end, -ahead))
    return _on_calendar(shifted, calendar, names).filter(inside)

"""Crawled events and venues to located, scored, flat event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.functions.values import NO_VENUE_SCORE, first_element
from kerbside.operators.nearest import k_nearest
from kerbside.session import materialize

MATCH_METRES = 50.0


def has_geometry(c: str = "geometry") -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def needs_geocode(events: DataFrame) -> DataFrame:
    """Distinct addresses of events without a location: the geocoder's work list."""
    return events.filter(~has_geometry() & F.col("address").isNotNull()).select("address").distinct()


def fill_geometry(events: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Locate events without geometry through a table ``address, lat, lng``.

    Only the events that need it take part in the join; the others pass by it, so their
    missing addresses cannot pile up on one key.
    """
    located_codes = geocodes.filter("lat IS NOT NULL AND lng IS NOT NULL")
    known = located_codes.groupBy("address").agg(F.min(F.struct("lat", "lng")).alias("at"))
    need = ~has_geometry() & F.col("address").isNotNull()
    done = events.filter(~need)
    filled = (
        events.filter(need).join(known, "address", "left")
        .withColumn("geometry", F.when(F.col("at").isNotNull(), F.array("at")).otherwise(F.col("geometry")))
        .select(*events.columns)
    )
    return done.unionByName(filled)


#: Levels below the cell that spans the match distance; the finest cells measure decimetres.
SEARCH_DEPTH = 3

#: From this latitude on the search reaches no farther in longitude.
POLAR_LATITUDE = 89.9


def nearest_venues(
    places: DataFrame, venues: DataFrame, metres: float = MATCH_METRES
) -> DataFrame:
    """``lat, lng, venue_id``: for each place the venue nearest in degrees, if closer than
    ``metres`` on the ground; the lowest id among venues equally near.

    The search sees as far as ``metres`` can span at the place farthest from the equator
    (one aggregate). A venue beyond that is no match, and if the nearest one in sight lies
    within, it is the nearest of all. Within a tenth of a degree of a pole, where degrees of
    longitude say nothing, places see as far as there. Each distinct location is looked up
    once, and venues sharing coordinates are reduced to their lowest id beforehand.
    """
    spots = (
        venues.filter("lat IS NOT NULL AND lon IS NOT NULL")
        .groupBy(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).agg(F.min("id").alias("id"))
    )
    probes = (
        places.filter("lat IS NOT NULL AND lng IS NOT NULL")
        .select("lat", F.col("lng").alias("lon")).distinct()
    )
    probes = materialize(probes, "places")
    farthest = probes.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    reach = geo.reach_in_degrees(metres, min(farthest, POLAR_LATITUDE)) * 1.0001
    near = k_nearest(probes, spots, 1, reach, SEARCH_DEPTH, within=reach)
    apart = geo.metres_between(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    return near.filter(apart < metres).select("lat", F.col("lon").alias("lng"), F.col("id").alias("venue_id"))


def located(events: DataFrame) -> DataFrame:
    at = first_element(F.col("geometry"))
    return events.withColumns({"lat": at["lat"], "lng": at["lng"]})


def match_venues(events: DataFrame, venues: DataFrame, metres: float = MATCH_METRES) -> DataFrame:
    """Events with ``venue`` (id and score), null where none is near. Each distinct
    location is looked up once, however many events share it."""
    places = venues.select("id", "score", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))
    spots = nearest_venues(located(events), places, metres)
    scores = venues.groupBy(F.col("id").alias("venue_id")).agg(F.first("score").alias("score"))
    found = spots.join(scores, "venue_id").select(
        "lat", "lng", F.struct(F.col("venue_id").alias("id"), "score").alias("venue"))
    return located(events).join(found, ["lat", "lng"], "left").select(*events.columns, "venue")


def flatten(events: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Flat rows of the events that take place and are located.

    The end falls back to the start; ``strict_reference`` always takes the start. An
    event without a venue scores -1; a venue without a score leaves it null.
    """
    at = first_element(F.col("geometry"))
    end = F.col("startDate") if strict_reference else F.coalesce("endDate", "startDate")
    kept = ~F.coalesce(F.col("canceled"), F.lit(False)) & has_geometry()
    score = F.when(F.col("venue").isNull(), F.lit(float(NO_VENUE_SCORE))).otherwise(F.col("venue.score"))
    return events.filter(kept).select(
        "id", "guid", F.col("startDate").alias("start_date"), end.alias("end_date"),
        F.col("allDay").alias("all_day"), score.cast("double").alias("score"),
        at["lat"].alias("latitude"), at["lng"].alias("longitude"))


def enrich_events(events: DataFrame, venues: DataFrame, geocodes: DataFrame,
                  strict_reference: bool = False) -> DataFrame:
    """Fill locations, match venues, drop what cannot be used, flatten."""
    return flatten(match_venues(fill_geometry(events, geocodes), venues), strict_reference)

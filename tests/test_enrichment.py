import math
import random

from conftest import tuples
from kerbside.functions import geo
from kerbside.operators import enrichment
from kerbside.operators.nearest import k_nearest
from kerbside.sources.events import EVENT_SCHEMA, GEOCODE_SCHEMA, VENUE_SCHEMA
from pyspark.sql import functions as F

NYC = (40.7, -74.0)
LAT_DEGREE = 111047.0  # metres, around NYC


def metres(a, b):
    """Plain-Python twin of the column expression."""
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    mid = math.radians((a[0] + b[0]) / 2)
    w2 = 1 - e2 * math.sin(mid) ** 2
    north = math.radians(b[0] - a[0]) * geo.EQUATOR_RADIUS_M * (1 - e2) / w2 ** 1.5
    east = math.radians(b[1] - a[1]) * geo.EQUATOR_RADIUS_M / math.sqrt(w2) * math.cos(mid)
    return math.hypot(north, east)


def nearest(spark, places, venues, **kw):
    p = spark.createDataFrame(places, "lat double, lng double")
    v = spark.createDataFrame(venues, "id string, lat double, lon double")
    return {(r.lat, r.lng): r.venue_id for r in enrichment.nearest_venues(p, v, **kw).collect()}


def brute(places, venues):
    out = {}
    for p in places:
        if None in p:
            continue
        best = min(((v[1] - p[0]) ** 2 + (v[2] - p[1]) ** 2, v[0], v) for v in venues if None not in v)[2]
        if metres(p, best[1:]) < 50:
            out[p] = best[0]
    return out


def test_49_and_51_metres(spark):
    place = [NYC]
    north = lambda m: [("V", NYC[0] + m / LAT_DEGREE, NYC[1])]
    assert nearest(spark, place, north(49)) == {NYC: "V"}
    assert nearest(spark, place, north(51)) == {}


def test_nearest_in_degrees_then_tested_in_metres(spark):
    # B is nearer in degrees yet beyond 50 m; A lies within 50 m but is farther in degrees
    far_north, near_east = ("B", NYC[0] + 51 / LAT_DEGREE, NYC[1]), ("A", NYC[0], NYC[1] + 0.00055)
    assert metres(NYC, near_east[1:]) < 50 and (NYC[0] - far_north[1]) ** 2 < 0.00055 ** 2
    assert nearest(spark, [NYC], [near_east, far_north]) == {}


def test_random_clusters_match_brute_force(spark):
    r = random.Random(7)
    spot = lambda s: (NYC[0] + r.gauss(0, s), NYC[1] + r.gauss(0, s))
    places = [spot(s) for s in (1e-5, 3e-4, 2e-3) for _ in range(150)] + [NYC, NYC, (None, 1.0)]
    venues = [(f"V{i:04d}", *spot(s)) for i, s in enumerate([2e-5] * 200 + [5e-4] * 60 + [4e-3] * 60)]
    venues += [("V9999", *venues[3][1:]), ("U0000", *venues[4][1:]), ("W", None, None)]
    assert nearest(spark, places, venues) == brute(places, venues)


def test_crowds_apart_from_each_other(spark):
    """All places in one spot, all venues in another some 30 m away: pairs would be quadratic."""
    r = random.Random(9)
    crowd = lambda n, lat, lon: [(lat + r.uniform(0, 4e-5), lon + r.uniform(0, 4e-5)) for _ in range(n)]
    places = crowd(400, *NYC)
    venues = [(f"V{i:04d}", *c) for i, c in enumerate(crowd(400, NYC[0] + 0.0002, NYC[1] + 0.0001))]
    assert nearest(spark, places, venues) == brute(places, venues)


def test_crowded_cell_opens_few_pairs(spark):
    """A third of both sides in one street corner; every probe must look at few venues."""
    n = 15000
    spot = lambda k, base, width: F.lit(base) + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10 ** 9)) / 1e9 * width
    crowd = F.col("id") % 3 == 0

    def scattered(k):
        return spark.range(n).select(
            "id", F.when(crowd, spot(k, 40.75, 4e-4)).otherwise(spot(k, 40.5, 0.4)).alias("lat"),
            F.when(crowd, spot(k + 1, -73.98, 4e-4)).otherwise(spot(k + 1, -74.2, 0.4)).alias("lon"))

    places = scattered(1).select("lat", "lon")
    venues = scattered(5).select(F.col("id").cast("string").alias("id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    got = k_nearest(places, venues, 1, 0.001, 3, within=0.001).cache()
    assert got.filter("rank = 1").count() == got.count()
    # 5,000 crowded places x 5,000 crowded venues would be 25 million pairs; the sample is checked exactly
    sample = [(r.lat, r.lon, r.id, r.d2) for r in got.filter("lat between 40.75 and 40.7504").limit(40).collect()]
    rows = [(r.p_lat, r.p_lon) for r in venues.collect()]
    for lat, lon, _, d2 in sample:
        assert d2 == min((a - lat) * (a - lat) + (b - lon) * (b - lon) for a, b in rows)


def test_high_latitude(spark):
    r = random.Random(8)
    spot = lambda: (59.9 + r.gauss(0, 3e-4), 10.7 + r.gauss(0, 6e-4))
    places, venues = [spot() for _ in range(80)], [(f"V{i:02d}", *spot()) for i in range(40)]
    assert nearest(spark, places, venues) == brute(places, venues)


def test_column_distance(spark):
    df = spark.createDataFrame([(*NYC, 40.7003, -74.0004)], "a double, b double, c double, d double")
    got = df.select(geo.metres_between(*[F.col(c) for c in "abcd"])).first()[0]
    assert abs(got - metres(NYC, (40.7003, -74.0004))) < 1e-9


def event(i, geometry=None, address=None, canceled=None, end="2014-01-01T10:00:00"):
    return (str(i), f"g{i}", "2014-01-01T08:00:00", end, False, canceled, address, geometry, None)


def test_pipeline(spark):
    here = [(40.7, -74.0)]
    rows = [
        event(1, here), event(2, [], "known"), event(3, None, "unknown"), event(4, here, canceled=True),
        event(5, here, canceled=False, end=None), event(6), event(7, [(41.0, -74.0)]), event(8, None, "nowhere"),
        event(9, [(42.0, -74.0)]),
    ]
    events = spark.createDataFrame(rows, EVENT_SCHEMA).drop("venue")
    venues = spark.createDataFrame(
        [("A", 0.7, (40.70001, -74.0)), ("B", None, (41.0, -74.0)), ("C", 0.9, None)], VENUE_SCHEMA)
    codes = spark.createDataFrame([("known", 40.7, -74.0), ("nowhere", None, None)], GEOCODE_SCHEMA)
    assert tuples(enrichment.needs_geocode(events)) == [("known",), ("nowhere",), ("unknown",)]
    flat = enrichment.enrich_events(events, venues, codes)
    assert tuples(flat, "id", "end_date", "score", "latitude") == [
        ("1", "2014-01-01T10:00:00", 0.7, 40.7), ("2", "2014-01-01T10:00:00", 0.7, 40.7),
        ("5", "2014-01-01T08:00:00", 0.7, 40.7), ("7", "2014-01-01T10:00:00", None, 41.0),
        ("9", "2014-01-01T10:00:00", -1.0, 42.0)]
    strict = enrichment.enrich_events(events, venues, codes, strict_reference=True)
    assert {r.end_date for r in strict.collect()} == {"2014-01-01T08:00:00"}


def test_matches_at_any_latitude(spark):
    """A degree of longitude is short far north: 0.0012 of it are 46 m at latitude 70."""
    places = spark.createDataFrame([(70.0, 25.0), (-70.0, 25.0), (40.0, 25.0), (None, 1.0)], "lat double, lng double")
    venues = spark.createDataFrame(
        [("n", 70.0, 25.0012), ("s", -70.0, 25.0012), ("e", 40.0, 25.0012)], "id string, lat double, lon double")
    assert tuples(enrichment.nearest_venues(places, venues), "lat", "venue_id") == [(-70.0, "s"), (70.0, "n")]
    assert enrichment.nearest_venues(places.limit(0), venues).count() == 0

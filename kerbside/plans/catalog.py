"""Every operator as a query over the test tables: ``name -> f(spark, sf_dir)``.

Nothing here computes on its own; the queries bind the operators to their inputs and
name the output columns. Results that are vectors or arrays are shown as text, doubles
that come from division are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geo, values
from kerbside.functions import timeparts as tp
from kerbside.models import forest as forest_nodes
from kerbside.models import prepare as prep
from kerbside.models import linear, score, train
from kerbside.operators import (
    enrichment,
    errors,
    facts,
    heatmaps,
    sampling,
    stats,
    trailing,
    venues,
    weather,
)
from kerbside.plans import bindings as b
from kerbside.plans.feature_table import feature_table
from kerbside.session import materialize, materialize_all, new_table_path
from kerbside.sources import events as event_files
from kerbside.sources import tables
from kerbside.sources import trips as trip_files
from kerbside.sources import weather as weather_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(f"`{c}`", 6) for c in columns})


def entries_text(entries: Column) -> Column:
    """A list of active venues as ``id:n,id:n``."""
    return F.concat_ws(",", F.transform(
        entries, lambda e: F.concat_ws(":", e["venue_id"].cast("string"), e["n"].cast("string"))))


# ---- district-hour facts and trailing counts ------------------------------------------


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.district_hours(b.trips(spark, sf))


@query
def district_hour_counts(spark, sf):
    return _facts(spark, sf)


@query
def trailing_district(spark, sf):
    rows = trailing.with_trailing_counts(_facts(spark, sf), neighbours=False)
    return rows.filter("Pickup_Count_Dis_1h IS NOT NULL")


@query
def trailing_neighbors(spark, sf):
    rows = trailing.with_trailing_counts(_facts(spark, sf))
    own = [c for c in rows.columns if "_Dis_" in c]
    return rows.filter("Pickup_Count_Nb_1h IS NOT NULL").drop(*own)


@query
def trailing_city(spark, sf):
    return trailing.city_trailing(_facts(spark, sf))


@query
def neighbor_counts(spark, sf):
    return trailing.neighbour_counts(_facts(spark, sf))


@query
def city_hours(spark, sf):
    return trailing.city_hours(_facts(spark, sf))


@query
def calendar_features(spark, sf):
    return tp.with_calendar(_facts(spark, sf).select("Time").distinct())


@query
def zero_filled_features(spark, sf):
    return feature_table(_facts(spark, sf), calendar=b.CALENDAR, gaps="zero")


def _inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """What the feature table is built from: each raw table scanned once, side by side,
    into the small table that all branches below share."""
    return materialize_all({
        "facts": _facts(spark, sf),
        "days": weather.station_days(b.observations(spark, sf)),
        "spans": venues.event_spans(b.city_events(spark, sf)),
    })


def _features(spark: SparkSession, sf: str, vectors: bool = False) -> DataFrame:
    """The full feature table of the test tables, venue lists and weather as arrays or as vectors.

    Vectors are built per hour and per day, before they meet the districts.
    """
    inputs = _inputs(spark, sf)
    ids = venues.venue_ids(inputs["spans"])
    lists = venues.venue_features(venues.venue_hours(inputs["spans"], ids, b.CALENDAR), b.CALENDAR)
    numbers = materialize(weather.station_numbers(inputs["days"]), "station-numbers")
    days = weather.weather_arrays(inputs["days"], numbers)
    if vectors:
        lists = prep.venue_vectors(lists, width=ids.count())  # the one number that fixes the vectors
        days = prep.weather_vectors(days, weather.station_names(numbers))
    else:
        days = weather.station_columns(days, weather.station_names(numbers))
    return feature_table(inputs["facts"], days, lists, b.CALENDAR)


@query
def feature_table_query(spark, sf):
    table = _features(spark, sf)
    table = rounded(table, *prep.weather_columns(table.columns))
    return table.withColumns({c: entries_text(F.col(f"`{c}`")) for c in prep.venue_columns(table.columns)})


QUERIES["feature_table"] = QUERIES.pop("feature_table_query")


# ---- weather --------------------------------------------------------------------------


def _station_days(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(weather.station_days(b.observations(spark, sf)), "station-days")


@query
def weather_pivot(spark, sf):
    days = _station_days(spark, sf)
    return weather.pivot_stations(days, weather.list_stations(days))


@query
def weather_imputed(spark, sf):
    days = _station_days(spark, sf)
    stations = weather.list_stations(days)
    wide = weather.impute_wide(weather.pivot_stations(days, stations), days, stations)
    return rounded(weather.unpivot(wide, stations), *weather.MEASURES)


@query
def weather_imputed_long(spark, sf):
    return rounded(weather.impute_long(_station_days(spark, sf)), *weather.MEASURES)


@query
def weather_by_number(spark, sf):
    """Arrays by station number, filled by joins as for any number of stations, written as the job
    writes them and read back entry by entry."""
    days = _station_days(spark, sf)
    numbers = materialize(weather.station_numbers(days), "station-numbers")
    arrays = materialize(weather.weather_arrays(days, numbers, in_rows=0), "weather-arrays")
    entries = arrays.select("Date", F.posexplode(F.arrays_zip(*weather.MEASURES)).alias("station_id", "v"))
    named = entries.join(numbers, "station_id").select("Date", "station_id", "Station", "v.*")
    return rounded(named, *weather.MEASURES)


@query
def measure_means(spark, sf):
    return rounded(weather.measure_means(weather.station_days(b.observations(spark, sf))), *weather.MEASURES)


@query
def station_coordinates(spark, sf):
    return weather.station_coordinates(weather.station_days(b.observations(spark, sf)))


@query
def station_neighbors(spark, sf):
    """The ten nearest other stations of each: here all of them."""
    days = weather.station_days(b.observations(spark, sf))
    return weather.nearest_stations(materialize(weather.station_coordinates(days), "stations"), 10)


@query
def station_coverage_daily(spark, sf):
    return weather.stations_per_day(b.observations(spark, sf, folded=False))


@query
def station_coverage_monthly(spark, sf):
    per_day = weather.stations_per_day(b.observations(spark, sf, folded=False))
    return rounded(weather.monthly_station_mean(per_day), "mean_station_count")


@query
def station_month_fraction(spark, sf):
    return rounded(weather.station_month_fraction(b.observations(spark, sf, folded=False)), "coverage")


@query
def daily_std(spark, sf):
    return rounded(weather.daily_spread(b.observations(spark, sf, folded=False)), *weather.MEASURES)


@query
def describe_measures(spark, sf):
    return rounded(stats.describe(b.observations(spark, sf, folded=False), weather.MEASURES), "mean", "std")


@query
def describe_station_counts(spark, sf):
    per_day = weather.stations_per_day(b.observations(spark, sf, folded=False))
    return rounded(stats.describe(per_day, ["station_count"]), "mean", "std")


@query
def describe_daily_std(spark, sf):
    spread = weather.daily_spread(b.observations(spark, sf, folded=False))
    described = stats.describe(rounded(spread, *weather.MEASURES), weather.MEASURES)
    return rounded(described, *SUMMARY)


SUMMARY = ("mean", "std", "min", "q25", "q50", "q75", "max")


@query
def describe_daily_measures(spark, sf):
    return rounded(stats.describe(b.daily_summaries(spark, sf), weather_files.DAILY_MEASURES), *SUMMARY)


@query
def describe_hourly_precipitation(spark, sf):
    return rounded(stats.describe(b.hourly_precipitation(spark, sf), ["HPCP"]), *SUMMARY)


@query
def hourly_coverage(spark, sf):
    calendar = tp.full_calendar(1995, 2001)
    return rounded(weather.hourly_coverage(b.hourly_series(spark, sf), calendar.table(spark)), "coverage")


@query
def measurements_per_hour(spark, sf):
    return weather.measurements_per_hour(b.hourly_series(spark, sf))


# ---- venue activity -------------------------------------------------------------------


def _activity(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events per venue and hour, and the venues."""
    spans = materialize(venues.event_spans(b.city_events(spark, sf)), "spans")
    ids = venues.venue_ids(spans)
    return venues.venue_hours(spans, ids, b.CALENDAR), ids


@query
def venue_ids(spark, sf):
    return venues.venue_ids(b.city_events(spark, sf))


@query
def event_hours(spark, sf):
    return _activity(spark, sf)[0]


@query
def event_grid_dense(spark, sf):
    dense = venues.dense_venue_hours(_activity(spark, sf)[0], b.CALENDAR)
    return dense.withColumn("Venues", entries_text(F.col("Venues")))


@query
def event_offsets(spark, sf):
    lists = venues.venue_features(_activity(spark, sf)[0], b.CALENDAR)
    return lists.withColumns({c: entries_text(F.col(f"`{c}`")) for c in prep.venue_columns(lists.columns)})


@query
def event_offsets_long(spark, sf):
    return venues.shifted_activity(_activity(spark, sf)[0])


# ---- heatmaps -------------------------------------------------------------------------

FRIDAYS = [date(2024, 1, d) for d in (5, 12, 19, 26)]
FRIDAY_HOUR = 19


def _pickups(spark: SparkSession, sf: str) -> DataFrame:
    return heatmaps.pickup_points(b.trips(spark, sf))


@query
def heatmap_total(spark, sf):
    return rounded(heatmaps.pickup_heatmap(_pickups(spark, sf)), "weight")


@query
def heatmap_by_weekday(spark, sf):
    return rounded(heatmaps.pickup_heatmap(_pickups(spark, sf), heatmaps.frame_weekday), "weight")


@query
def heatmap_by_hour(spark, sf):
    return rounded(heatmaps.pickup_heatmap(_pickups(spark, sf), heatmaps.frame_hour), "weight")


@query
def heatmap_four_days(spark, sf):
    return rounded(heatmaps.same_hour_days(_pickups(spark, sf), FRIDAYS, FRIDAY_HOUR), "weight")


@query
def heatmap_weekday_slice(spark, sf):
    return rounded(heatmaps.weekday_slice(_pickups(spark, sf), FRIDAYS[0].weekday(), FRIDAY_HOUR), "weight")


@query
def event_heatmap(spark, sf):
    return rounded(heatmaps.event_heatmap(heatmaps.event_points(b.city_events(spark, sf))), "weight")


@query
def event_heatmap_by_weekday(spark, sf):
    points = heatmaps.event_points(b.city_events(spark, sf))
    return rounded(heatmaps.event_heatmap(points, heatmaps.frame_weekday), "weight")


@query
def event_heatmap_by_hour(spark, sf):
    points = heatmaps.event_points(b.city_events(spark, sf))
    return rounded(heatmaps.event_heatmap(points, heatmaps.frame_hour), "weight")


def _restored(spark: SparkSession, weights: DataFrame, frames: DataFrame, part_points: int = heatmaps.PART_POINTS) -> DataFrame:
    path = new_table_path(spark, "heatmap")
    tables.write_documents(heatmaps.documents(weights, frames, part_points), path)
    return rounded(tables.read_documents(spark, path), "weight")


@query
def heatmap_documents(spark, sf):
    weights = heatmaps.pickup_heatmap(_pickups(spark, sf), heatmaps.frame_hour)
    return _restored(spark, weights, heatmaps.hour_frames(spark))


@query
def event_documents(spark, sf):
    """Events by weekday; parts of a few points, so that frames come back from several."""
    weights = heatmaps.event_heatmap(heatmaps.event_points(b.city_events(spark, sf)), heatmaps.frame_weekday)
    return _restored(spark, weights, heatmaps.weekday_frames(spark), part_points=3)


# ---- statistics and slices ------------------------------------------------------------


@query
def trip_histograms(spark, sf):
    return stats.time_histograms(b.trips(spark, sf), "Pickup_Time")


@query
def value_counts(spark, sf):
    return stats.value_counts(b.trips(spark, sf), "Passenger_Count")


@query
def distance_outliers(spark, sf):
    return stats.distance_outliers(b.trips(spark, sf))


@query
def outlier_audit(spark, sf):
    return stats.outlier_audit(b.trips(spark, sf))


@query
def events_per_month(spark, sf):
    return stats.events_per_month(b.city_events(spark, sf))


@query
def avg_events_per_day(spark, sf):
    return rounded(stats.average_events_per_day(b.city_events(spark, sf)), "events_per_day")


@query
def date_slice(spark, sf):
    orders = b.table(spark, sf, "orders")
    sliced = stats.date_slice(orders, "o_orderdate", date(1996, 2, 1), date(1996, 2, 29))
    return sliced.select("o_orderkey", "o_orderdate")


@query
def preview(spark, sf):
    return stats.preview(b.trips(spark, sf).select("event_id", "Pickup_Time"), 5, "Pickup_Time", "event_id")


@query
def coordinate_guard(spark, sf):
    """Longitudes as text, some of them no numbers."""
    text = F.when(F.col("event_id") % 23 == 0, "x").otherwise(F.col("Start_Lon").cast("string"))
    lon = values.number_or_null(text)
    trips = b.trips(spark, sf).withColumn("lon", lon)
    return trips.agg(
        F.count("*").alias("trips"), F.count("lon").alias("numeric_lon"),
        F.count_if(geo.in_bounds(F.col("Start_Lat"), F.col("lon"))).alias("usable"))


@query
def scalar_functions(spark, sf):
    e = b.table(spark, sf, "events")
    t, value = F.col("ts").cast("timestamp"), F.col("value")
    hour, weekday = F.hour(t).cast("int"), tp.weekday_ix(t)
    text = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), value.cast("string")))
    return e.select(
        "event_id", tp.hour_of(t).alias("hour_start"), tp.plus_hours(tp.hour_of(t), 3).alias("plus_3h"),
        hour.alias("hour"), F.dayofyear(t).cast("int").alias("day_of_year"), weekday.alias("weekday"),
        F.year(t).cast("int").alias("year"), F.month(t).cast("int").alias("month"),
        F.weekofyear(t).cast("int").alias("week"), F.to_date(t).alias("day"),
        tp.compact_date(F.date_format(t, "yyyyMMdd")).alias("compact_day"),
        tp.compact_minute(F.date_format(t, "yyyyMMdd HH:mm")).alias("compact_minute"),
        tp.iso_prefix(F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))).alias("iso_second"),
        tp.is_holiday(t).alias("holiday"), tp.hour_label(hour).alias("hour_label"),
        tp.weekday_label(weekday).alias("weekday_name"), F.round(value, 2).alias("value_2"),
        F.round(F.sqrt(F.abs(value)), 6).alias("root"),
        F.round(F.pow(F.lit(2.0), -(F.col("user_id") % 5)), 6).alias("node_value"),
        F.greatest("user_id", F.lit(1).cast("bigint")).alias("at_least_one"),
        values.number_or_null(text).alias("number"))


# ---- errors ---------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """The naive forecast: as many pickups as in the hour before."""
    rows = trailing.with_trailing_counts(_facts(spark, sf), hours=(1,), neighbours=False)
    return rows.filter("Pickup_Count_Dis_1h IS NOT NULL").select(
        "Time", "Lat", "Lon", F.col("Pickup_Count_Dis_1h").cast("double").alias("prediction"),
        F.col("Pickup_Count").cast("double").alias("label"))


STATS = ("mse", "rmse", "mspe", "rmspe", "mpe")


@query
def hourly_errors(spark, sf):
    return rounded(errors.hourly_errors(_scored(spark, sf)), "proportional_error", "squared_proportional_error")


@query
def error_metrics(spark, sf):
    return rounded(errors.district_errors(_scored(spark, sf)), *STATS)


@query
def error_spread(spark, sf):
    spread = errors.error_spread(errors.district_errors(_scored(spark, sf)))
    return rounded(spread, "rmse_mean", "rmse_std", "mpe_mean", "mpe_std")


@query
def daily_errors(spark, sf):
    return rounded(errors.daily_errors(_scored(spark, sf)), *STATS)


@query
def weekly_errors(spark, sf):
    return rounded(errors.weekly_errors(_scored(spark, sf)), *STATS)


@query
def error_columns(spark, sf):
    daily = errors.daily_errors(_scored(spark, sf))
    return rounded(errors.comparison(daily), "mpe_scaled", "rmspe_scaled", "rmse")


@query
def best_worst_days(spark, sf):
    return errors.best_and_worst_days(_scored(spark, sf))


@query
def best_worst_weeks(spark, sf):
    return errors.best_and_worst_weeks(_scored(spark, sf))


@query
def best_worst_day_rows(spark, sf):
    return errors.rows_of_extremes(_scored(spark, sf), "day")


@query
def best_worst_week_rows(spark, sf):
    return errors.rows_of_extremes(_scored(spark, sf), "week")


@query
def daily_mean_label(spark, sf):
    return rounded(errors.daily_mean_label(_scored(spark, sf)), "mean_label")


# ---- districts, split, samples --------------------------------------------------------


@query
def top_districts(spark, sf):
    return facts.top_districts(_facts(spark, sf), 5)


@query
def district_rows(spark, sf):
    return facts.district_rows(_facts(spark, sf))


@query
def listed_districts(spark, sf):
    counts = _facts(spark, sf)
    return facts.of_districts(counts, facts.top_districts(counts, 5), max_districts=5)


@query
def sample_districts(spark, sf):
    return facts.sample_districts(_facts(spark, sf), n=4, among=8)


def _split(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    before, after = facts.split_by_time(_facts(spark, sf), b.SPLIT, strict)
    return stats.concat([before.withColumn("part", F.lit("train")), after.withColumn("part", F.lit("test"))])


@query
def train_split(spark, sf):
    return _split(spark, sf, False)


@query
def train_split_strict(spark, sf):
    return _split(spark, sf, True)


@query
def sample_by_key(spark, sf):
    return sampling.bernoulli_by_key(b.table(spark, sf, "events"), ["event_id"], 0.1, 1234).select("event_id", "ts")


@query
def sample_by_year(spark, sf):
    orders = b.table(spark, sf, "orders")
    kept = sampling.yearly_sample(orders, "o_orderdate", ["o_orderkey"], 7, by_year={1996: 0.5})
    return kept.select("o_orderkey", "o_orderdate")


@query
def bernoulli_sample(spark, sf):
    return sampling.bernoulli(b.table(spark, sf, "events"), 10.0, 1234).select("event_id", "ts")


# ---- enrichment -----------------------------------------------------------------------


@query
def geocode_fill(spark, sf):
    filled = enrichment.fill_geometry(b.crawled_events(spark, sf), b.geocodes(spark, sf))
    return rounded(enrichment.located(filled).withColumn("lat", F.col("lat")), "lat", "lng").select(
        "id", "address", "lat", "lng")


@query
def needs_geocode(spark, sf):
    return enrichment.needs_geocode(b.crawled_events(spark, sf))


@query
def nearest_venue(spark, sf):
    filled = enrichment.fill_geometry(b.crawled_events(spark, sf), b.geocodes(spark, sf))
    places = b.crawled_venues(spark, sf).select(
        "id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))
    return rounded(enrichment.nearest_venues(enrichment.located(filled), places), "lat", "lng")


@query
def flatten_events(spark, sf):
    flat = enrichment.enrich_events(b.crawled_events(spark, sf), b.crawled_venues(spark, sf), b.geocodes(spark, sf))
    return rounded(flat, "latitude", "longitude")


# ---- files ----------------------------------------------------------------------------


@query
def trip_csv_scan(spark, sf):
    """Two families of trip files with other headers and widths, read back by position."""
    trips = b.trips(spark, sf)
    when = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("Pickup_Time", "Dropoff_Time")]
    lon = F.when(F.col("event_id") % 23 == 0, "x").otherwise(F.col("Start_Lon").cast("string"))
    picked = [*when, F.col("Passenger_Count"), F.col("Trip_Distance"), lon, F.col("Start_Lat"),
              F.lit("a"), F.lit("b"), F.col("End_Lon"), F.col("End_Lat")]
    paths = []
    for width, names, rows in (
        (11, "vendor p d n dist x y r s ex ey", trips.filter("event_id % 2 = 0")),
        (13, "id start end count miles lon lat code flag lon2 lat2 fare tip", trips.filter("event_id % 2 = 1")),
    ):
        extra = [F.lit("1")] * (width - 11)
        path = new_table_path(spark, "trips")
        rows.select(F.lit("v"), *picked, *extra).toDF(*names.split()).write.option("header", True).csv(path)
        paths.append(path)
    return trip_files.read_trips(spark, paths, trip_files.SAMPLE_POSITIONS)


@query
def yearly_samples(spark, sf):
    """Trip files of one month in two folders, sampled by year and merged by position."""
    base = new_table_path(spark, "yearly")
    stamp = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("Pickup_Time", "Dropoff_Time")]
    rows = b.trips(spark, sf).select(
        "event_id", *stamp, "Passenger_Count", F.col("Trip_Distance").cast("int"), F.lit(0), F.lit(0), F.lit("N"), F.lit(1),
        F.lit(0), F.lit(0)).toDF(*"event_id p d n dist lon lat rate flag elon elat".split())
    for year, odd in ((2013, 0), (2014, 1)):
        rows.filter(F.col("event_id") % 2 == odd).write.option("header", True).csv(f"{base}/trips_{year}-01.csv")
    lines = trip_files.read_lines(spark, f"{base}/trips_*.csv")
    trip_files.write_lines(sampling.yearly_lines(lines, 1234, 0.1), f"{base}/sample")
    merged = trip_files.merge_samples(spark, f"{base}/sample")
    return merged.select("Pickup_Time", "Dropoff_Time", "Passenger_Count", "Trip_Distance")


@query
def file_list_scan(spark, sf):
    path = new_table_path(spark, "filelist")
    t = F.col("ts")
    lines = b.table(spark, sf, "events").select(F.concat(
        F.year(t), F.lit("/trips_"), F.date_format(t, "yyyy-MM"), F.lit(".csv")).alias("value")).distinct()
    lines.write.text(path)
    return trip_files.listed_files(spark, path)


@query
def weather_csv_scan(spark, sf):
    path = new_table_path(spark, "weather")
    raw = b.weather_raw(spark, sf)
    raw = raw.withColumn("DATE", F.date_format("DATE", "yyyyMMdd"))
    raw.write.option("header", True).csv(path)
    return weather_files.read_daily(spark, path, raw.columns)


@query
def hourly_precipitation_scan(spark, sf):
    path = new_table_path(spark, "precipitation")
    e = b.table(spark, sf, "events")
    value = F.when(F.col("event_id") % 9 == 0, F.lit(-9999)).otherwise(F.col("user_id") % 50)
    e.select(F.lit("S00").alias("STATION"), F.date_format("ts", "yyyyMMdd HH:mm").alias("DATE"),
             value.alias("HPCP")).write.option("header", True).csv(path)
    return weather_files.read_hourly(spark, path)


@query
def event_json_roundtrip(spark, sf):
    """Documents written and read back before they are enriched."""
    path, venue_path = new_table_path(spark, "events"), new_table_path(spark, "venues")
    event_files.write_events(b.crawled_events(spark, sf), path)
    b.crawled_venues(spark, sf).write.json(venue_path)
    crawled = event_files.read_events(spark, path, array_file=False).drop("venue")
    flat = enrichment.enrich_events(
        crawled, event_files.read_venues(spark, venue_path, array_file=False), b.geocodes(spark, sf))
    return rounded(flat, "latitude", "longitude")


@query
def event_array_scan(spark, sf):
    """Documents of array files, one array a file, before they are enriched."""
    path = new_table_path(spark, "event-arrays")
    event_files.write_event_arrays(b.crawled_events(spark, sf), path)
    crawled = event_files.read_events(spark, path).drop("venue")
    flat = enrichment.enrich_events(crawled, b.crawled_venues(spark, sf), b.geocodes(spark, sf))
    return rounded(flat, "latitude", "longitude")


@query
def flat_event_csv(spark, sf):
    path = new_table_path(spark, "flat-events")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    flat = b.city_events(spark, sf).withColumns({c: F.date_format(c, iso) for c in ("start_date", "end_date")})
    event_files.write_flat(flat, path)
    return event_files.read_flat(spark, path)


@query
def facts_by_month(spark, sf):
    path = new_table_path(spark, "facts")
    tables.write_by_month(_facts(spark, sf), path)
    return tables.read_by_month(spark, path)


@query
def district_list_scan(spark, sf):
    path = new_table_path(spark, "districts")
    tables.write_districts(_facts(spark, sf).select("Lat", "Lon").distinct(), path)
    return tables.read_districts(spark, path)


@query
def prediction_csv(spark, sf):
    path = new_table_path(spark, "predictions")
    tables.write_predictions(_scored(spark, sf), path)
    return tables.read_predictions(spark, path)


@query
def error_csv(spark, sf):
    path = new_table_path(spark, "errors")
    tables.write_errors(errors.district_errors(_scored(spark, sf)), path)
    return rounded(tables.read_errors(spark, path), *STATS)


# ---- models ---------------------------------------------------------------------------


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(_features(spark, sf, vectors=True), "features")


def _profile(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per vector entry that is ever set: its name, on how many rows it is, and its sum."""
    entry = F.posexplode(vector_to_array("features")).alias("position", "value")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1)
    return (
        rows.select(entry).filter("value <> 0").groupBy("position")
        .agg(F.count("*").alias("rows"), F.round(F.sum("value"), 3).alias("total"))
        .select(name.alias("feature"), "rows", "total")
    )


@query
def onehot_features(spark, sf):
    """Vectors of the training rows, categories one column each."""
    prepared = prep.prepare(_model_rows(spark, sf), scale=False, one_hot=True, split=b.SPLIT)
    return _profile(prepared.train, prepared.feature_names())


@query
def scaled_features(spark, sf):
    """Vectors of the held-out rows, scaled by the training rows' deviation."""
    prepared = prep.prepare(_model_rows(spark, sf), scale=True, one_hot=False, split=b.SPLIT)
    return _profile(prepared.test, prepared.feature_names())


def _districts(spark: SparkSession, rows: DataFrame) -> list[tuple[float, float]]:
    """The list of districts to train, read from a file: here all that have training rows."""
    path = new_table_path(spark, "listed")
    tables.write_districts(rows.select("Lat", "Lon").distinct(), path)
    return sorted(tables.district_list(spark, path))


@query
def train_linear(spark, sf):
    """Least squares per district on the preceding hour's pickups and the hour of day."""
    rows = trailing.with_trailing_counts(_facts(spark, sf), hours=(1,), neighbours=False)
    rows = tp.with_calendar(rows.filter("Pickup_Count_Dis_1h IS NOT NULL"))
    fitted = train.fit_linear_all(rows, ["Pickup_Count_Dis_1h", "Hour"])
    w = F.col("coefficients")
    return fitted.select("Lat", "Lon", "rows", F.round(w[0], 6).alias("w_trailing"), F.round(w[1], 6).alias("w_hour"))


def _linear_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the preceding hour's pickups and the hour of day, before and after the split."""
    rows = trailing.with_trailing_counts(_facts(spark, sf), hours=(1,), neighbours=False)
    rows = tp.with_calendar(rows.filter("Pickup_Count_Dis_1h IS NOT NULL"))
    return facts.split_by_time(materialize(rows, "linear-rows"), b.SPLIT)


def _linear_errors(before: DataFrame, chosen: DataFrame) -> DataFrame:
    columns = ["Pickup_Count_Dis_1h", "Hour"]
    scored = train.predict_linear_all(chosen, train.fit_linear_all(before, columns), columns)
    return rounded(errors.district_errors(scored), *STATS)


@query
def predict_linear(spark, sf):
    """Fit before the split, predict what follows, compare with what happened."""
    return _linear_errors(*_linear_split(spark, sf))


@query
def training_errors(spark, sf):
    """Errors on the rows that were fitted."""
    before, _ = _linear_split(spark, sf)
    return _linear_errors(before, before)


@query
def sampled_errors(spark, sf):
    """Errors on a drawn half of the rows that follow the split."""
    before, after = _linear_split(spark, sf)
    return _linear_errors(before, score.sampled(after, 0.5))


@query
def category_arity(spark, sf):
    """Per category of the vectors that forests get: its number of values, and the rows' values."""
    prepared = _forest_rows(spark, sf)
    attrs = [a for kind in prepared.train.schema["features"].metadata["ml_attr"]["attrs"].values() for a in kind if "vals" in a]
    rows = prepared.train.select(vector_to_array("features").alias("v"))
    entry = F.explode(F.array(*[F.struct(
        F.lit(a["name"]).alias("feature"), F.lit(len(a["vals"])).alias("arity"), F.col("v")[a["idx"]].alias("value")) for a in attrs]))
    return rows.select(entry.alias("e")).groupBy("e.feature", "e.arity").agg(
        F.min("e.value").alias("lowest"), F.max("e.value").alias("highest"), F.countDistinct("e.value").alias("values"))


@query
def train_linear_vectors(spark, sf):
    """The linear model on the whole prepared vector, saved, loaded and evaluated."""
    models, _, held_out = _linear_models(spark, sf)
    return rounded(errors.district_errors(linear.predict_all(held_out, models)), *STATS)


def _linear_models(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved and loaded models of all listed districts, training rows and held-out rows."""
    prepared = prep.prepare(_model_rows(spark, sf), split=b.SPLIT)
    rows, held_out = train.by_cell(prepared.train, prepared.test)
    listed = _districts(spark, rows)
    folder = new_table_path(spark, "linear")
    linear.save(linear.fit_all(train.of_listed(rows, listed)), folder)
    return linear.load(spark, folder, listed), rows, held_out


@query
def linear_orthogonality(spark, sf):
    """What holds for least squares on any vector: no column is left that a residual follows,
    beyond what the ridge term asks for."""
    models, rows, _ = _linear_models(spark, sf)
    off = linear.gradients(rows, models).groupBy("Lat", "Lon").agg(F.bool_and(F.col("off") < 1e-9).alias("orthogonal"))
    fitted = models.withColumns({"Lat": F.col("lat_cell") / 100, "Lon": F.col("lon_cell") / 100}).select("Lat", "Lon", "rows")
    return fitted.join(off, ["Lat", "Lon"])


def _forest_rows(spark: SparkSession, sf: str) -> prep.Prepared:
    return prep.prepare(_model_rows(spark, sf), scale=False, one_hot=False, split=b.SPLIT)


#: Settings of the forests: the published ones of the single run that was analysed.
TREES, DEPTH = 5, 15

_trained: dict[tuple[str, str], tuple[str, list[tuple[float, float]], list[str], DataFrame]] = {}


def _forests(spark: SparkSession, sf: str) -> tuple[str, list[tuple[float, float]], list[str], DataFrame]:
    """Folder of the saved forests of all listed districts, the districts, the names of the
    features, and the held-out rows. Trained once per session and input; later queries load
    what is saved."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        prepared = _forest_rows(spark, sf)
        rows, held_out = train.by_cell(prepared.train, prepared.test)
        listed = _districts(spark, rows)
        folder = new_table_path(spark, "forests")
        train.train_districts(rows, listed, lambda: train.forest(TREES, DEPTH), folder)
        _trained[key] = folder, listed, prepared.feature_names(), held_out
    return _trained[key]


@query
def train_forest(spark, sf):
    """A forest per district: trained before the split, saved, loaded, evaluated after it."""
    folder, listed, _, held_out = _forests(spark, sf)
    return rounded(score.evaluate(held_out, score.load_models(folder, "random_forest", listed)), *STATS)


FOREST = ("Lat", "Lon")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of all listed districts' saved forests."""
    folder, listed, _, _ = _forests(spark, sf)
    return reduce(DataFrame.unionByName, [
        forest_nodes.saved_nodes(spark, train.model_path(folder, *d)).withColumns({"Lat": F.lit(d[0]), "Lon": F.lit(d[1])})
        for d in listed])


def _splits(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Split nodes of all listed districts' forests, at all levels, and the features' names."""
    return forest_nodes.splits_by_level(_nodes(spark, sf), keys=(*FOREST, "tree")), _forests(spark, sf)[2]


@query
def forest_importance(spark, sf):
    splits, names = _splits(spark, sf)
    return forest_nodes.named(forest_nodes.importance(splits, keys=FOREST), names)


@query
def forest_top_features(spark, sf):
    splits, names = _splits(spark, sf)
    return forest_nodes.named(forest_nodes.top_features(splits, keys=FOREST), names)


@query
def forest_feature_counts(spark, sf):
    splits, names = _splits(spark, sf)
    return forest_nodes.named(forest_nodes.feature_counts(splits, keys=FOREST), names)


@query
def forest_structure(spark, sf):
    """What holds for every forest: its trees, one leaf more per tree than inner nodes, and
    a score of 1 for the root of each tree."""
    nodes, (splits, _) = _nodes(spark, sf), _splits(spark, sf)
    inner = F.col("feature").isNotNull()
    shape = nodes.groupBy(*FOREST).agg(
        F.countDistinct("tree").cast("bigint").alias("trees"),
        (F.count("*") - 2 * F.sum(inner.cast("int"))).alias("leaves_over_inner"))
    roots = splits.filter("level = 0").groupBy(*FOREST).agg(F.sum(F.pow(F.lit(2.0), -F.col("level"))).alias("root_score"))
    return shape.join(roots, list(FOREST))


@query
def forest_scored_rows(spark, sf):
    """Rows scored per listed district, and whether all predictions lie within its labels."""
    folder, listed, _, held_out = _forests(spark, sf)
    scored = score.score_districts(held_out, score.load_models(folder, "random_forest", listed))
    before = prep.split_by_time(_features(spark, sf, vectors=False), b.SPLIT)[0].groupBy(*FOREST).agg(
        F.min("Pickup_Count").alias("low"), F.max("Pickup_Count").alias("high"))
    return scored.join(before, list(FOREST)).groupBy(*FOREST).agg(
        F.count("*").alias("scored"), F.bool_and((F.col("prediction") >= F.col("low") - 1e-9) & (
            F.col("prediction") <= F.col("high") + 1e-9)).alias("within_labels"))


@query
def holidays(spark, sf):
    """Holidays among all order dates, laid 27 years ahead to reach beyond 2021."""
    day = F.date_add(F.to_date("o_orderdate"), 9862)
    days = b.table(spark, sf, "orders").select(day.alias("day")).distinct()
    return days.filter(tp.is_holiday(F.col("day"))).select("day")

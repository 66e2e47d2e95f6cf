"""Station observations: means, nearest-station order, transposition, imputation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.operators.nearest import k_nearest
from kerbside.operators.numbering import numbered
from kerbside.session import materialize

# The measures that the feature table uses.
MEASURES = ["TMIN", "TMAX", "PRCP", "AWND"]
NEIGHBOURS_USED = 3

#: Above this many stations no view with one column per station and measure is given; tables
#: hold one array per measure (``weather_arrays``), for any number of stations.
MAX_WIDE_STATIONS = 128


def station_days(observations: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per day and station; repeated observations are summed, missing ones skipped.

    Beside each sum stand what means over the raw rows need: how many rows there were, how
    many had the measure, and the summed coordinates. Everything below is computed from
    this table, so the observations are scanned once.
    """
    return observations.groupBy("Date", "Station").agg(
        F.count("*").alias("rows"), F.sum("Lat").alias("lat_sum"), F.sum("Lon").alias("lon_sum"),
        *[F.sum(m).alias(m) for m in measures],
        *[F.count(m).alias(f"{m}_rows") for m in measures],
    )


def measure_means(days: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row: the mean of each measure over all observations that have it."""
    return days.agg(*[(F.sum(m) / F.nullif(F.sum(f"{m}_rows"), F.lit(0))).alias(m) for m in measures])


def station_coordinates(days: DataFrame) -> DataFrame:
    return days.groupBy("Station").agg(
        (F.sum("lat_sum") / F.sum("rows")).alias("Lat"), (F.sum("lon_sum") / F.sum("rows")).alias("Lon"))


@dataclass(frozen=True)
class Station:
    name: str
    lat: float
    lon: float


def list_stations(days: DataFrame, limit: int = MAX_WIDE_STATIONS) -> list[Station]:
    """Stations in name order. An action, on at most ``limit`` + 1 rows: the station list
    fixes the columns of the wide table, so it has to be known while planning."""
    rows = station_coordinates(days).orderBy("Station").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} stations: use impute_long")
    return [Station(r.Station, r.Lat, r.Lon) for r in rows]


def nearest_first(station: Station, stations: Sequence[Station]) -> list[Station]:
    """The other stations by distance in degrees, equal distances by name."""
    others = [s for s in stations if s.name != station.name]
    return sorted(others, key=lambda s: ((s.lat - station.lat) ** 2 + (s.lon - station.lon) ** 2, s.name))


#: Start of the neighbour search: cells wider than the globe, so every station is in sight,
#: then down to a 64th of a degree.
SEARCH_DEGREES = 512.0
SEARCH_DEPTH = 5


def nearest_stations(coordinates: DataFrame, k: int) -> DataFrame:
    """The ``k`` other stations nearest to each, as rows ``Station, Neighbour, Rank``; equal
    distances rank by name.

    A self-join on the cells of the nearest-point search: one search per place, for one
    station more, out of which each station of the place then strikes itself.
    """
    points = coordinates.select(F.col("Station").alias("id"), F.col("Lat").alias("p_lat"), F.col("Lon").alias("p_lon"))
    probes = coordinates.select(F.col("Lat").alias("lat"), F.col("Lon").alias("lon")).distinct()
    near = k_nearest(probes, points, k + 1, SEARCH_DEGREES, SEARCH_DEPTH).select(
        F.col("lat").alias("Lat"), F.col("lon").alias("Lon"), F.col("id").alias("Neighbour"), "rank")
    others = coordinates.select("Station", "Lat", "Lon").join(near, ["Lat", "Lon"]).filter(
        ~F.col("Station").eqNullSafe(F.col("Neighbour")))
    place = F.row_number().over(W.partitionBy("Station").orderBy("rank")).alias("Rank")
    return others.select("Station", "Neighbour", place).filter(F.col("Rank") <= k)


def wide_name(measure: str, station: str) -> str:
    return f"{measure}_{station}"


def wide_names(stations: Sequence[Station], measures: Sequence[str] = MEASURES) -> list[str]:
    """Columns of the wide table, by measure and then station, in name order."""
    return [wide_name(m, s.name) for m in sorted(measures) for s in stations]


def pivot_stations(
    days: DataFrame, stations: Sequence[Station], measures: Sequence[str] = MEASURES
) -> DataFrame:
    """One row per day, one column per measure and station, null where nothing was measured."""
    names = [s.name for s in stations]
    pivoted = days.groupBy("Date").pivot("Station", names).agg(*[F.sum(m).alias(m) for m in measures])
    given = (lambda m, s: f"{s}_{m}") if len(measures) > 1 else (lambda m, s: s)
    return pivoted.select("Date", *[
        F.col(f"`{given(m, s.name)}`").alias(wide_name(m, s.name))
        for m in sorted(measures) for s in stations
    ])


# Mean of the first values that are not missing; null when all are.
_MEAN_OF_FIRST_KNOWN = """
    aggregate(slice(filter(transform(near, j -> {values}[j]), x -> x IS NOT NULL), 1, {k}),
              named_struct('total', 0D, 'n', 0),
              (a, x) -> named_struct('total', a.total + x, 'n', a.n + 1),
              a -> IF(a.n > 0, a.total / a.n, NULL))"""


def impute_in_rows(
    wide: DataFrame, days: DataFrame, stations: Sequence[Station], measures: Sequence[str] = MEASURES
) -> DataFrame:
    """``Date`` and an array per measure, by station: each gap filled with the mean of the nearest
    three stations measuring that day, or with the mean over the whole period when none does.

    A projection over the pivoted row: no join, no shuffle. Each measure's values stand in
    one array by station, and the constant neighbour order says where to look. The period
    means are scalar subqueries over the small table of station days.
    """
    at = {s.name: i for i, s in enumerate(stations)}
    order = ", ".join(
        "array(" + ", ".join(str(at[o.name]) for o in nearest_first(s, stations)) + ")" for s in stations)
    if len(stations) == 1:
        order = "CAST(array() AS array<int>)"
    means = measure_means(days, measures)
    known = wide.select(
        "Date",
        *[F.array(*[F.col(f"`{wide_name(m, s.name)}`") for s in stations]).alias(f"values_{m}") for m in measures],
        *[means.select(m).scalar().alias(f"mean_{m}") for m in measures])
    return known.select("Date", *[
        F.expr(f"""transform(array({order}), (near, i) -> coalesce(values_{m}[i],
            {_MEAN_OF_FIRST_KNOWN.format(values=f"values_{m}", k=NEIGHBOURS_USED)}, mean_{m}))""").alias(m)
        for m in sorted(measures)])


def impute_wide(
    wide: DataFrame, days: DataFrame, stations: Sequence[Station], measures: Sequence[str] = MEASURES
) -> DataFrame:
    """The same with one column per measure and station."""
    filled = impute_in_rows(wide, days, stations, measures)
    return filled.select("Date", *[
        F.col(m)[i].alias(wide_name(m, s.name)) for m in sorted(measures) for i, s in enumerate(stations)])


def daily_weather(days: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Station days to the imputed wide table, for few stations."""
    stations = list_stations(days)
    return impute_wide(pivot_stations(days, stations, measures), days, stations, measures)


def unpivot(wide: DataFrame, stations: Sequence[Station], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Wide rows back to one row per day and station."""
    entries = F.array(*[
        F.struct(F.lit(s.name).alias("Station"),
                 *[F.col(f"`{wide_name(m, s.name)}`").alias(m) for m in measures])
        for s in stations
    ])
    return wide.select("Date", F.inline(entries))


def _nearest_known(gaps: DataFrame, known: DataFrame) -> DataFrame:
    """``Date, measure, Lat, Lon, mean``: for each gap the mean of the nearest three values
    of the same measure and day."""
    probes = gaps.select("Date", "measure", F.col("Lat").alias("lat"), F.col("Lon").alias("lon")).distinct()
    points = known.select("Date", "measure", F.col("Station").alias("id"), F.col("Lat").alias("p_lat"),
                          F.col("Lon").alias("p_lon"), "value")
    near = k_nearest(probes, points, NEIGHBOURS_USED, SEARCH_DEGREES, SEARCH_DEPTH, keys=["Date", "measure"])
    return near.groupBy("Date", "measure", F.col("lat").alias("Lat"), F.col("lon").alias("Lon")) \
        .agg((F.sum("value") / F.count("*")).alias("mean"))


#: Neighbours of a station that are tried before the search is widened.
NEIGHBOURS_TRIED = 8


def _every_day(stations: DataFrame, days: DataFrame) -> DataFrame:
    """``Date, Station, Lat, Lon``: a row per station and observed day. Days are generated from
    the first to the last; two dates are all that travels."""
    first, last = (days.agg(f("Date")).scalar() for f in (F.min, F.max))
    everywhere = stations.withColumn("Date", F.explode(F.sequence(first, last)))
    return everywhere.join(days.select("Date").distinct(), "Date", "left_semi").select("Date", "Station", "Lat", "Lon")


def impute_long(
    days: DataFrame, measures: Sequence[str] = MEASURES, tried: int = NEIGHBOURS_TRIED, means: DataFrame | None = None,
) -> DataFrame:
    """The same imputation for any number of stations: rows ``Date, Station, measures``.

    Gaps first meet the values of their station's nearest neighbours, found once for all days.
    Only where these give fewer values than are needed, and the day has others, the search
    is widened, for those gaps alone.
    """
    stations = materialize(station_coordinates(days), "stations")
    near = nearest_stations(stations, tried)
    at_all = days.groupBy("Date").agg(*[F.count(m).alias(f"{m}_known") for m in measures])
    values = materialize(_every_day(stations, days).join(days.select("Date", "Station", *measures), ["Date", "Station"], "left"), "station-values")
    gap = F.greatest(*[F.col(m).isNull().cast("int") for m in measures]) == 1 if len(measures) > 1 else F.col(measures[0]).isNull()
    met = values.filter(gap).select("Date", "Station").join(near, "Station").join(
        days.select("Date", F.col("Station").alias("Neighbour"), *measures), ["Date", "Neighbour"])
    around = met.groupBy("Date", "Station").agg(F.array_sort(F.collect_list(F.struct("Rank", *measures))).alias("around"))

    def known(m: str) -> Column:
        return F.slice(F.filter(F.transform("around", lambda n: n[m]), lambda v: v.isNotNull()), 1, NEIGHBOURS_USED)

    def entry(m: str) -> Column:
        found = F.col(f"{m}_near")
        number = F.coalesce(F.size(found), F.lit(0))
        mean = F.aggregate(found, F.lit(0.0), lambda s, v: s + v) / number
        is_open = F.col(m).isNull() & (number < NEIGHBOURS_USED) & (F.col(f"{m}_known") > number)
        return F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.when(number > 0, mean).alias("mean"), is_open.alias("open"))

    around = around.select("Date", "Station", *[known(m).alias(f"{m}_near") for m in measures])
    rows = values.join(around, ["Date", "Station"], "left").join(at_all, "Date")
    cells = materialize(rows.select("Date", "Station", "Lat", "Lon", F.inline(F.array(*[entry(m) for m in measures]))), "station-cells")
    value = F.coalesce("value", "mean")
    wanting = cells.filter("open")
    if not wanting.isEmpty():
        wide = _nearest_known(wanting, cells.filter("value IS NOT NULL")).withColumnRenamed("mean", "wide_mean")
        cells = cells.join(wide, ["Date", "measure", "Lat", "Lon"], "left")
        value = F.coalesce("value", F.when(F.col("open"), F.col("wide_mean")).otherwise(F.col("mean")))
    means = measure_means(days, measures) if means is None else means
    return cells.groupBy("Date", "Station").agg(*[
        F.max(F.when(F.col("measure") == m, value)).alias(m) for m in measures
    ]).select("Date", "Station", *[F.coalesce(F.col(m), means.select(m).scalar()).alias(m) for m in measures])


def station_numbers(days: DataFrame) -> DataFrame:
    """``station_id, Station``: named stations numbered in name order."""
    return numbered(days.filter("Station IS NOT NULL").select("Station").distinct(), ["Station"], "station_id")


def station_names(numbers: DataFrame) -> list[str]:
    """Names by number, on the driver: vectors name their entries in the table's schema. One short
    text per station, never per observation."""
    return [r.Station for r in numbers.orderBy("station_id").collect()]


def weather_arrays(
    days: DataFrame, numbers: DataFrame, measures: Sequence[str] = MEASURES, in_rows: int = MAX_WIDE_STATIONS,
) -> DataFrame:
    """One row per observed day: ``Date`` and per measure the filled values of all stations, in one
    array by station number.

    However many stations there are, the table has one column per measure. Observations
    without a station name count for the means and have no place in the arrays. Up to
    ``in_rows`` stations the neighbour order is part of the plan and gaps are filled within a
    day's row; beyond that they are filled by joins, with the same values.
    """
    named, means = days.filter("Station IS NOT NULL"), measure_means(days, measures)
    is_few = numbers.limit(in_rows + 1).count() <= in_rows
    stations = list_stations(named, in_rows) if is_few else []
    if stations:
        return impute_in_rows(pivot_stations(named, stations, measures), days, stations, measures)
    filled = impute_long(named, measures, means=means).join(numbers, "Station")
    entry = F.struct("station_id", *measures)
    per_day = filled.groupBy("Date").agg(F.array_sort(F.collect_list(entry)).alias("values"))
    return per_day.select("Date", *[F.col("values").getField(m).alias(m) for m in sorted(measures)])


def station_columns(arrays: DataFrame, stations: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Arrays by station number as one column per measure and station, for few stations."""
    if len(stations) > MAX_WIDE_STATIONS:
        raise ValueError(f"more than {MAX_WIDE_STATIONS} stations: use the arrays")
    rest = [F.col(f"`{c}`") for c in arrays.columns if c not in measures]
    return arrays.select(*rest, *[
        F.get(m, F.lit(i)).alias(wide_name(m, s)) for m in sorted(measures) for i, s in enumerate(stations)])


# ---- coverage statistics -------------------------------------------------------------


def stations_per_day(observations: DataFrame) -> DataFrame:
    """Observations with a station name per day."""
    return observations.groupBy("Date").agg(F.count("Station").alias("station_count"))


def monthly_station_mean(per_day: DataFrame) -> DataFrame:
    """Mean of the daily station counts by month, labelled with the month's last day."""
    return (
        per_day.groupBy(F.last_day("Date").alias("month_end"))
        .agg(F.avg("station_count").alias("mean_station_count"))
    )


def station_month_fraction(observations: DataFrame) -> DataFrame:
    """Share of the observed days of a month on which a station reports.

    Days are bits of a number per station and month, merged by ``or`` where the observations
    lie: a station's month is one row, however often it reports. Each station that ever reports
    gets a row in every observed month, 0 where it was silent; months are generated.
    """
    month = F.trunc("Date", "month")
    day = F.expr("shiftleft(1L, dayofmonth(Date) - 1)")
    bits = materialize(observations.groupBy("Station", month.alias("month")).agg(F.bit_or(day).alias("days")), "station-months")
    months = bits.groupBy("month").agg(F.bit_or("days").alias("observed"))
    first, last = (months.agg(f("month")).scalar() for f in (F.min, F.max))
    # a station has as many entries as the calendar has months
    per_station = bits.filter("Station IS NOT NULL").groupBy("Station").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "days"))).alias("held"))
    grid = per_station.select(
        "Station", "held", F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))
    return grid.join(months, "month").select(
        F.year("month").cast("int").alias("year"), F.month("month").cast("int").alias("month"), "Station",
        (F.coalesce(F.bit_count(F.try_element_at("held", F.col("month"))), F.lit(0)) / F.bit_count("observed")).alias("coverage"))


def daily_spread(observations: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Population standard deviation over the stations of a day, per measure."""
    return observations.groupBy("Date").agg(*[F.stddev_pop(m).alias(m) for m in measures])


def hourly_coverage(series: DataFrame, calendar: DataFrame, time: str = "Time") -> DataFrame:
    """Share of the calendar's hours per month for which the series has a row."""
    seen = series.select(F.date_trunc("hour", time).alias("Time")).distinct().withColumn("seen", F.lit(1))
    return (
        calendar.join(seen, "Time", "left")
        .groupBy(F.year("Time").cast("int").alias("year"), F.month("Time").cast("int").alias("month"))
        .agg(F.avg(F.coalesce("seen", F.lit(0)).cast("double")).alias("coverage"))
    )


def measurements_per_hour(series: DataFrame, time: str = "Time") -> DataFrame:
    """Rows by hour of the day."""
    return series.groupBy(F.hour(time).cast("int").alias("hour")).agg(F.count("*").alias("n"))



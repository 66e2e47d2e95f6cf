import random
from datetime import date

import pytest

from conftest import at, tuples
from kerbside import sizing
from kerbside.functions.timeparts import HourRange
from kerbside.models import prepare
from kerbside.operators import weather

OBS = "Date date, Lat double, Lon double, Station string, TMIN double, TMAX double, PRCP double, AWND double"
PLACES = {"A": (0.0, 0.0), "B": (0.0, 1.0), "C": (0.0, 2.0), "D": (0.0, 4.0), "E": (0.0, 7.0)}


def day(n):
    return date(2014, 1, n)


def obs(spark, *rows):
    """Rows of (day, station, value); the value stands for all four measures."""
    return spark.createDataFrame([(day(d), *PLACES[s], s, v, v, v, v) for d, s, v in rows], OBS)


def imputed(spark, *rows, long=False):
    """PRCP by day and station, from the wide form, on request compared with the long one."""
    days = weather.station_days(obs(spark, *rows))
    stations = weather.list_stations(days)
    wide = weather.impute_wide(weather.pivot_stations(days, stations), days, stations)
    rows = weather.unpivot(wide, stations)
    if long:
        assert tuples(rows) == tuples(weather.impute_long(days))
    return {(r.Date.day, r.Station): r.PRCP for r in rows.collect()}


def test_three_nearest_with_a_value(spark):
    got = imputed(spark, (1, "A", None), (1, "B", 1.0), (1, "C", 2.0), (1, "D", 6.0), (1, "E", 100.0), (2, "A", 8.0))
    assert got[1, "A"] == 3.0
    # B, C, D are nearer to E than A is, but only A has a value on day 2
    assert got[2, "E"] == 8.0


def test_fewer_than_three_and_none(spark):
    got = imputed(spark, (1, "A", None), (1, "B", 1.0), (1, "C", 4.0), (2, "A", None), (2, "B", None), (2, "C", None))
    assert got[1, "A"] == 2.5
    assert got[2, "A"] == got[2, "B"] == got[2, "C"] == 2.5  # the mean over the whole period


def test_absent_station_day_and_repeats(spark):
    got = imputed(spark, (1, "A", 1.0), (1, "A", 2.0), (1, "B", 5.0), (2, "B", 7.0))
    assert got[1, "A"] == 3.0  # repeated observations of a day are summed
    assert got[2, "A"] == 7.0


def test_equal_distances_take_the_smaller_name(spark):
    near = weather.nearest_first(weather.Station("M", 0, 0), [weather.Station(n, 0, x) for n, x in
                                                              (("Z", 1.0), ("B", -1.0), ("M", 0.0), ("C", 0.5))])
    assert [s.name for s in near] == ["C", "B", "Z"]
    df = weather.station_days(obs(spark, (1, "A", 1.0), (1, "B", 1.0), (1, "C", 1.0)))
    near = weather.nearest_stations(weather.station_coordinates(df), 5)
    assert tuples(near.filter("Station = 'B'"), "Neighbour", "Rank") == [("A", 1), ("C", 2)]


def test_single_station(spark):
    assert imputed(spark, (1, "A", 4.0), (2, "A", None)) == {(1, "A"): 4.0, (2, "A"): 4.0}


def test_random_long_equals_wide(spark):
    r = random.Random(4)
    imputed(spark, *[(r.randrange(1, 20), r.choice("ABCDE"), r.choice([None, 1.0, 2.0, 5.0])) for _ in range(60)], long=True)


def test_long_form_with_scattered_stations(spark):
    """Far more stations than a wide table takes, against brute force."""
    r = random.Random(5)
    at_place = {f"T{i:03d}": (r.gauss(0, 1) * 10 ** r.randrange(-1, 2), r.gauss(0, 1) * 10 ** r.randrange(-1, 2)) for i in range(150)}
    rows = [(day(d), *at_place[s], s, *([r.choice([None, float(r.randrange(50))])] * 4)) for d in (1, 2) for s in at_place]
    rows += [(day(3), *at_place[s], s, *([v] * 4)) for s, v in (("T000", 1.0), ("T001", 5.0), ("T002", None))]
    known = {(x[0].day, x[3]): x[4] for x in rows if x[4] is not None}
    mean = sum(known.values()) / len(known)
    got = weather.impute_long(weather.station_days(spark.createDataFrame(rows, OBS))).collect()
    assert len(got) == 3 * 150
    for g in got:
        k = (g.Date.day, g.Station)
        if k in known:
            assert g.TMIN == known[k]
            continue
        la, lo = at_place[g.Station]
        near = sorted(((at_place[s][0] - la) ** 2 + (at_place[s][1] - lo) ** 2, s, v) for (d, s), v in known.items() if d == k[0])[:3]
        assert g.TMIN == pytest.approx(sum(x[2] for x in near) / len(near) if near else mean)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_stations(spark, k):
    """Against all pairs: clusters, and many stations at one place."""
    r = random.Random(6)
    places = {f"S{i:03d}": (round(r.gauss(40, 3), 2), round(r.gauss(-74, 3), 2)) if i % 3 else (40.0, -74.0) for i in range(90)}
    coordinates = spark.createDataFrame([(s, *p) for s, p in places.items()], "Station string, Lat double, Lon double")
    expected = []
    for s, (la, lo) in places.items():
        others = sorted(((p[0] - la) ** 2 + (p[1] - lo) ** 2, o) for o, p in places.items() if o != s)[:k]
        expected += [(s, o, rank) for rank, (_, o) in enumerate(others, 1)]
    assert tuples(weather.nearest_stations(coordinates, k), "Station", "Neighbour", "Rank") == sorted(expected)
    assert weather.nearest_stations(coordinates.limit(1), k).count() == 0


@pytest.mark.parametrize("tried", [1, 3])
def test_long_form_widens_its_search(spark, tried):
    r = random.Random(7)
    rows = [(d, s, r.choice([None, None, 1.0, 2.0, 5.0])) for d in range(1, 12) for s in "ABCDE"]
    days = weather.station_days(obs(spark, *rows))
    stations = weather.list_stations(days)
    wide = weather.unpivot(weather.impute_wide(weather.pivot_stations(days, stations), days, stations), stations)
    assert tuples(weather.impute_long(days, tried=tried)) == tuples(wide)


def test_period_mean_is_over_observations_not_days(spark):
    days = weather.station_days(obs(spark, (1, "A", 1.0), (1, "A", 2.0), (2, "A", 6.0), (3, "A", None)))
    assert weather.measure_means(days).first().PRCP == 3.0


def test_wide_columns_and_limit(spark):
    days = weather.station_days(obs(spark, (1, "A", 1.0), (1, "B", 2.0)))
    assert weather.daily_weather(days).columns == ["Date"] + [
        f"{m}_{s}" for m in ("AWND", "PRCP", "TMAX", "TMIN") for s in "AB"]
    with pytest.raises(ValueError, match="impute_long"):
        weather.list_stations(days, limit=1)


def test_arrays_by_station_number(spark):
    r = random.Random(9)
    rows = [(d, s, r.choice([None, 1.0, 2.0, 5.0])) for d in range(1, 9) for s in "EBDCA"]
    days = weather.station_days(obs(spark, *rows))
    numbers = weather.station_numbers(days)
    assert tuples(numbers) == [(i, s) for i, s in enumerate("ABCDE")]
    assert weather.station_names(numbers) == list("ABCDE")
    arrays = weather.weather_arrays(days, numbers)
    joined = weather.weather_arrays(days, numbers, in_rows=4)
    for form in (arrays, joined):
        assert tuples(weather.station_columns(form, list("ABCDE"))) == tuples(weather.daily_weather(days))
    with pytest.raises(ValueError, match="arrays"):
        weather.station_columns(arrays, ["S"] * 129)
    assert weather.weather_arrays(days.limit(0), numbers).count() == 0


def test_unnamed_observations_count_for_the_means_alone(spark):
    known = obs(spark, (1, "A", 2.0), (1, "B", 4.0), (2, "A", None))
    unnamed = known.limit(1).selectExpr("Date", "Lat", "Lon", "CAST(NULL AS STRING) AS Station", "9D AS TMIN", "9D AS TMAX", "9D AS PRCP", "9D AS AWND")
    days = weather.station_days(known.unionByName(unnamed))
    for in_rows in (0, 128):
        arrays = weather.weather_arrays(days, weather.station_numbers(days), in_rows=in_rows)
        assert tuples(arrays, "Date", "PRCP") == [(day(1), [2.0, 4.0]), (day(2), [5.0, 5.0])]


def test_weather_vectors_name_their_entries(spark):
    days = weather.station_days(obs(spark, (1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0)))
    numbers = weather.station_numbers(days)
    arrays = weather.weather_arrays(days, numbers)
    vectors = prepare.weather_vectors(arrays, weather.station_names(numbers))
    assert [a["name"] for a in vectors.schema["PRCP"].metadata["ml_attr"]["attrs"]["numeric"]] == ["A", "B"]
    assert [list(r.PRCP) for r in vectors.orderBy("Date").collect()] == [[1.0, 2.0], [3.0, 3.0]]
    assert sizing.row_width(vectors.schema) is not None and sizing.row_width(arrays.schema) is None
    with pytest.raises(Exception, match="not one value per station"):
        prepare.weather_vectors(arrays, ["A"]).collect()
    never = weather.station_days(obs(spark, (1, "A", None)))
    with pytest.raises(Exception, match="not one value per station"):
        prepare.weather_vectors(weather.weather_arrays(never, weather.station_numbers(never)), ["A"]).collect()


def test_coverage(spark):
    df = obs(spark, (1, "A", 1.0), (1, "B", 1.0), (2, "A", None), (3, "A", 1.0), (4, "B", 1.0))
    assert tuples(weather.stations_per_day(df), "station_count") == [(1,), (1,), (1,), (2,)]
    assert tuples(weather.monthly_station_mean(weather.stations_per_day(df))) == [(date(2014, 1, 31), 1.25)]
    assert tuples(weather.station_month_fraction(df)) == [(2014, 1, "A", 0.75), (2014, 1, "B", 0.5)]
    late = [(date(2014, 3, d), 0.0, 0.0, s, *[1.0] * 4) for d, s in ((31, "A"), (31, None), (30, None))]
    more = df.unionByName(spark.createDataFrame(late, OBS))
    assert tuples(weather.station_month_fraction(more)) == [
        (2014, 1, "A", 0.75), (2014, 1, "B", 0.5), (2014, 3, "A", 0.5), (2014, 3, "B", 0.0)]


def test_spread_is_of_the_population(spark):
    df = obs(spark, (1, "A", 1.0), (1, "B", 3.0), (1, "C", None), (2, "A", 5.0))
    assert tuples(weather.daily_spread(df), "Date", "PRCP") == [(day(1), 1.0), (day(2), 0.0)]


def test_hourly_coverage_counts_hours_without_data(spark):
    series = spark.createDataFrame([(at("2014-01-31 22:10:00"),), (at("2014-01-31 22:50:00"),), (at("2014-02-01 00:00:00"),)],
                                   "Time timestamp")
    calendar = HourRange(at("2014-01-31 20:00:00"), at("2014-02-01 01:00:00")).table(spark)
    assert tuples(weather.hourly_coverage(series, calendar)) == [(2014, 1, 0.25), (2014, 2, 0.5)]
    assert tuples(weather.measurements_per_hour(series)) == [(0, 1), (22, 2)]

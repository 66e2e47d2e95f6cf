"""The jobs from raw files to error table, on a few weeks of made-up traffic."""

import csv
import json
import random
from datetime import timedelta

import pytest

from conftest import at, tuples
from kerbside.plans.jobs import main
from kerbside.sources import tables

PLACES = [(40.70, -74.00), (40.71, -74.00), (40.70, -73.99)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("jobs")
    r = random.Random(3)
    start = at("2014-12-20 00:00:00")
    with open(d / "trips_2014-12.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow("v p d n dist lon lat rate flag elon elat".split())
        for i in range(20 * 24 * 8):
            t = start + timedelta(minutes=i * 60 / 8)
            a, b = r.choice(PLACES), r.choice(PLACES)
            w.writerow(["V", t, t + timedelta(minutes=r.randrange(50)), 1, 2.5, a[1], a[0], 1, "", b[1], b[0]])
    (d / "files.txt").write_text("2014/trips_2014-12.csv\n")
    with open(d / "weather.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow("STATION STATION_NAME LATITUDE LONGITUDE DATE PRCP TMAX TMIN AWND".split())
        for n in range(22):
            for s in range(3):
                w.writerow([f"S{s}", "x", 40 + s, -74, (start + timedelta(days=n)).strftime("%Y%m%d"),
                            r.choice([-9999, 0, 4]), r.randrange(20), -9999 if s == 1 else -3, 5])
    events = [{"id": str(i), "guid": f"g{i}", "allDay": False, "address": "Hall" if i % 4 == 0 else None,
               "startDate": (start + timedelta(hours=5 * i)).isoformat(), "endDate": (start + timedelta(hours=5 * i + 2)).isoformat(),
               "canceled": i % 9 == 0, "geometry": [] if i % 4 == 0 else [{"lat": 40.7 + (i % 3) / 100, "lng": -74.0}]}
              for i in range(90)]
    (d / "events.json").write_text(json.dumps(events))
    (d / "venues.json").write_text(json.dumps([{"id": "V", "score": 0.6, "location": {"lat": 40.7, "lon": -74.0}}]))
    (d / "codes.csv").write_text("address,lat,lng\nHall,40.7,-74.0\n")
    return d


def test_whole_pipeline(spark, folder):
    p = lambda *x: str(folder.joinpath(*x))
    years = ["--first-year", "2014", "--last-year", "2015"]
    main(["trips", str(folder), p("facts"), "--file-list", p("files.txt")], spark)
    assert spark.read.parquet(p("facts")).agg({"Pickup_Count": "sum"}).first()[0] == 20 * 24 * 8
    main(["weather", p("weather.csv"), p("weather")], spark)
    assert tuples(spark.read.parquet(p("weather", "stations"))) == [(0, "S0"), (1, "S1"), (2, "S2")]
    arrays = spark.read.parquet(p("weather", "days"))
    assert len(arrays.columns) == 5 and arrays.count() == 22
    assert arrays.filter("TMIN[1] <> -3 OR size(PRCP) <> 3").count() == 0
    main(["enrich", p("events.json"), p("venues.json"), p("codes.csv"), p("flat")], spark)
    main(["events", p("flat"), p("venue_features"), *years], spark)
    main(["features", p("facts"), p("weather"), p("venue_features"), p("features"), *years], spark)
    features = spark.read.parquet(p("features"))
    assert features.count() > 1000 and features.first()["Venues_0h"].size == 3
    assert all(v.size == 3 and v[1] == -3 for v, in features.select("TMIN").distinct().collect())
    main(["districts", p("facts"), p("districts"), "--n", "2", "--among", "3"], spark)
    listed = tables.district_list(spark, p("districts"))
    assert len(listed) == 2
    for kind in ("random_forest", "linear"):
        main(["train", p("features"), p("models", kind), p("districts"), "--kind", kind, "--trees", "2", "--depth", "3",
              "--numeric-categories"], spark)
        main(["evaluate", p("features"), p("models", kind), p("districts"), p("result", kind), "--kind", kind], spark)
        errors = tables.read_errors(spark, p("result", kind, "errors"))
        assert tuples(errors, "Lat", "Lon") == sorted(listed, key=repr)
        scored = tables.read_predictions(spark, p("result", kind, "predictions"))
        assert scored.count() == features.filter("in_year = 2015").join(
            spark.createDataFrame(listed, "Lat double, Lon double"), ["Lat", "Lon"]).count()
    lat, lon = listed[0]
    main(["importance", p("models", "random_forest", f"model_{lat}_{lon}"), p("importance")], spark)
    assert spark.read.option("header", True).csv(p("importance")).columns == ["feature", "score"]


def test_maps_samples_and_slices(spark, folder):
    p = lambda *x: str(folder.joinpath(*x))
    main(["enrich", p("events.json"), p("venues.json"), p("codes.csv"), p("map_events")], spark)
    main(["heatmaps", p("trips_2014-12.csv"), p("maps"), "--events", p("map_events"), "--days", "2014-12-25", "2014-12-26"], spark)
    frames = {"pickups": 1, "pickups_by_weekday": 7, "pickups_by_hour": 24, "pickups_same_hour": 2,
              "events": 1, "events_by_weekday": 7, "events_by_hour": 24}
    for name, number in frames.items():
        assert tables.read_documents(spark, p("maps", name)).select("name").distinct().count() == number
    main(["sample", p("trips_2014-12.csv"), "10", p("sample")], spark)
    assert 250 < spark.read.option("header", True).csv(p("sample")).count() < 520
    main(["slice", p("trips_2014-12.csv"), p("slice"), "--first", "2014-12-25", "--last", "2014-12-26"], spark)
    assert spark.read.option("header", True).csv(p("slice")).count() == 2 * 24 * 8


def test_yearly_samples(spark, folder):
    p = lambda *x: str(folder.joinpath(*x))
    main(["sample-years", p("trips_2014-12.csv"), p("all_years"), "--fraction", "1"], spark)
    merged = spark.read.option("header", True).csv(p("all_years", "merged"))
    assert merged.count() == 20 * 24 * 8 and merged.columns[2:5] == ["Passenger_Count", "Trip_Distance", "Start_Lon"]
    lines = spark.read.text(p("all_years", "years", "year=2014")).filter("value <> 'line'")
    assert tuples(lines) == sorted(((x,) for x in (folder / "trips_2014-12.csv").read_text().splitlines()[1:]), key=repr)
    main(["sample-years", p("trips_2014-12.csv"), p("some_years"), "--fraction", "0.1"], spark)
    assert 250 < spark.read.option("header", True).csv(p("some_years", "merged")).count() < 520


def test_reports(spark, folder):
    p = lambda *x: str(folder.joinpath(*x))
    rows = lambda *x: spark.read.option("header", True).csv(p(*x))
    main(["report-trips", p("trips_2014-12.csv"), p("r_trips")], spark)
    assert rows("r_trips", "outliers").first().trips == str(20 * 24 * 8)
    assert rows("r_trips", "histograms").filter("part = 'hour'").count() == 24
    (folder / "hourly.csv").write_text("STATION,DATE,HPCP\nS0,20150101 01:00,1.5\nS0,20150101 02:00,-9999\n")
    main(["report-weather", p("weather.csv"), p("r_weather"), "--hourly", p("hourly.csv"), "--first-year", "2015", "--last-year", "2015"], spark)
    assert tuples(rows("r_weather", "measures"), "measure", "count")[0] == ("AWND", "66")
    assert rows("r_weather", "hourly_precipitation").first()["count"] == "1"
    assert rows("r_weather", "station_months").count() == 6 and rows("r_weather", "hourly_coverage").count() == 12
    main(["enrich", p("events.json"), p("venues.json"), p("codes.csv"), p("r_flat")], spark)
    main(["report-events", p("r_flat"), p("r_events")], spark)
    assert rows("r_events", "events_per_month").count() == 2
    scored = spark.createDataFrame(
        [(at(f"2015-01-{d:02d} 05:00:00"), 40.7, -74.0, float(d), 5.0) for d in range(1, 15)],
        "Time timestamp, Lat double, Lon double, prediction double, label double")
    tables.write_predictions(scored, p("r_predictions"))
    main(["report-errors", p("r_predictions"), p("r_errors")], spark)
    assert rows("r_errors", "daily").count() == 14 and rows("r_errors", "best_worst_days").first().best_day == "5"

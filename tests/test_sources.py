import json

import pytest

from pyspark.sql import functions as F

from conftest import at, tuples
from kerbside.operators import heatmaps
from kerbside.sources import events, tables, trips, weather


def test_trip_files_with_other_headers_and_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "vendor,Trip_Pickup,Trip_Dropoff,Pax,Dist,Lon,Lat,Rate,Flag,ELon,ELat\n"
        "V,2009-01-01 10:00:00,2009-01-01 10:20:00,208,3.2,-73.99,40.74,1,,-73.98,40.75\n"
        "V,2009-01-01 10:00:00,bad,0,-1,x,,1,,NaN,40.75\n")
    (tmp_path / "b.csv").write_text(
        "id, start, end, n, miles, lon1, lat1, code, hold, lon2, lat2, fare, tip\n"
        "1, 2015-06-01 00:00:00, 2015-06-01 00:05:00, 1, 0.5, -73.9, 40.7, 1, N, -73.8, 40.8, 5.0, 1\n")
    (tmp_path / "list.txt").write_text("2009/a.csv\n2015/b.csv\n\n")
    paths = trips.listed_paths(spark, str(tmp_path), str(tmp_path / "list.txt"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.csv", "b.csv"]
    df = trips.read_trips(spark, paths, trips.SAMPLE_POSITIONS)
    assert tuples(df) == [
        (at("2009-01-01 10:00:00"), None, 0, -1.0, None, None, None, 40.75),
        (at("2009-01-01 10:00:00"), at("2009-01-01 10:20:00"), 208, 3.2, -73.99, 40.74, -73.98, 40.75),
        (at("2015-06-01 00:00:00"), at("2015-06-01 00:05:00"), 1, 0.5, -73.9, 40.7, -73.8, 40.8),
    ]
    assert trips.read_trips(spark, paths).columns == list(trips.TRIP_POSITIONS.values())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_weather_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text(
        "STATION,STATION_NAME,LATITUDE,LONGITUDE,DATE,PRCP,TMAX,TMIN,AWND\n"
        "S1,One,40.1,-74.1,20140131,-9999,10,-5,3\n")
    path = str(tmp_path / "w.csv")
    r = weather.read_daily(spark, path, weather.read_header(spark, path)).first()
    assert (str(r.Date), r.Lat, r.Station, r.TMIN, r.TMAX, r.PRCP, r.AWND) == ("2014-01-31", 40.1, "S1", -5.0, 10.0, None, 3.0)
    (tmp_path / "h.csv").write_text("STATION,DATE,HPCP\nS1,20140131 17:00,-9999\n")
    assert tuples(weather.read_hourly(spark, str(tmp_path / "h.csv"))) == [("S1", at("2014-01-31 17:00:00"), None)]


def test_event_arrays_and_flat_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([
        {"id": "1", "guid": "g", "startDate": "2014-01-01T08:00:00", "allDay": True, "geometry": [{"lat": 1.5, "lng": 2.5}]},
        {"id": "2", "guid": "h", "startDate": "2014-01-01T08:00:00", "allDay": False, "address": "here", "canceled": True}], indent=1))
    df = events.read_events(spark, str(tmp_path / "e.json"))
    assert tuples(df, "id", "canceled", "address") == [("1", None, None), ("2", True, "here")]
    events.write_events(df, str(tmp_path / "lines"))
    assert tuples(events.read_events(spark, str(tmp_path / "lines"), array_file=False)) == tuples(df)
    many = spark.range(1234).select(F.col("id").cast("string"), F.lit("a \"[{\" b").alias("address")).repartition(3)
    events.write_event_arrays(many, str(tmp_path / "arrays"), per_file=100)
    back = events.read_events(spark, str(tmp_path / "arrays"))
    assert tuples(back, "id", "address") == tuples(many) and back.filter("guid IS NOT NULL").count() == 0
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] == 100
    (tmp_path / "v.json").write_text('[{"id": "V", "score": 0.5, "location": {"lat": 1.0, "lon": 2.0}}, {"id": "W"}]')
    assert tuples(events.read_venues(spark, str(tmp_path / "v.json")), "id", "score") == [("V", 0.5), ("W", None)]
    (tmp_path / "f.csv").write_text(
        "id,guid,start_date,end_date,all_day,score,latitude,longitude\n"
        "1,g,2014-01-01T08:00:00-05:00,2014-01-01T10:00:00,True,-1,40.7,bad\n")
    flat = events.read_flat(spark, str(tmp_path / "f.csv"))
    assert tuples(flat) == [("1", "g", at("2014-01-01 08:00:00"), at("2014-01-01 10:00:00"), True, -1.0, 40.7, None)]


def test_districts(spark, tmp_path):
    (tmp_path / "d.txt").write_text("40.72,-73.94\n40.8, -73.95\n")
    assert tables.district_list(spark, str(tmp_path / "d.txt")) == [(40.72, -73.94), (40.8, -73.95)]


def test_predictions_keep_the_pair_separator(spark, tmp_path):
    df = spark.createDataFrame([(at("2015-01-01 05:00:00"), 40.72, -73.94, 1.5, 2.0)],
                               "Time timestamp, Lat double, Lon double, prediction double, label double")
    tables.write_predictions(df, str(tmp_path / "p"))
    part, = (tmp_path / "p" / "lat_cell=4072" / "lon_cell=-7394").glob("*.csv")
    assert part.read_text() == "time, prediction, label\n2015-01-01 05:00:00, 1.5, 2.0\n"
    assert tuples(tables.read_predictions(spark, str(tmp_path / "p"))) == tuples(df)


def test_months_prune_directories(spark, tmp_path):
    df = spark.createDataFrame([(at(f"2015-{m:02d}-01 05:00:00"), m) for m in (1, 2, 3)], "Time timestamp, n int")
    tables.write_by_month(df, str(tmp_path / "m"))
    read = tables.read_by_month(spark, str(tmp_path / "m"), at("2015-02-01 00:00:00"), at("2015-02-01 05:00:00"))
    assert tuples(read, "n") == [(2,)]
    assert "PartitionFilters: [isnotnull(in_year" in read._jdf.queryExecution().executedPlan().toString()


def test_a_feature_called_month_survives(spark, tmp_path):
    df = spark.createDataFrame([(at("2015-03-01 05:00:00"), 3, 1)], "Time timestamp, Month int, Day int")
    tables.write_by_month(df, str(tmp_path / "m"))
    read = tables.read_by_month(spark, str(tmp_path / "m"))
    assert read.columns == ["Time", "Month", "Day"] and tuples(read, "Month", "Day") == [(3, 1)]


def test_documents_of_empty_whole_and_cut_frames(spark, tmp_path):
    west = [(8, 40.7, -74.0 + i / 1000, 1.0 / (i + 1)) for i in range(-3, 4) if i != -1]  # on both sides of a square's edge
    weights = spark.createDataFrame([*west, (8, 41.7, -74.0, 0.25), (9, 40.7, -74.0, 1.0)],
                                    "frame int, lat double, lon double, weight double")
    whole = heatmaps.documents(weights, heatmaps.hour_frames(spark)).collect()
    assert len(whole) == 48 and {d.part for d in whole} == {"0", "index"}  # a frame is one document, and its index
    by_part = lambda docs: {(d.name, d.part): json.loads(d.document) for d in docs}
    assert by_part(whole)["00", "0"] == {"title": "00:00", "pointRadius": 10, "data": []}
    assert by_part(whole)["00", "index"] == {"title": "00:00", "pointRadius": 10, "points": 0, "parts": ["0"]}
    assert len(by_part(whole)["08", "0"]["data"]) == 7
    cut = heatmaps.documents(weights, heatmaps.hour_frames(spark), part_points=3)
    cut_parts = by_part(cut.collect())
    listed = cut_parts["08", "index"]
    assert listed["points"] == 7 and len(listed["parts"]) > 1
    assert sum(len(cut_parts["08", p]["data"]) for p in listed["parts"]) == 7
    tables.write_documents(cut, str(tmp_path / "d"))
    points = tables.read_documents(spark, str(tmp_path / "d"))
    assert tuples(points.filter("name = '08'"), "lat", "lon", "weight") == tuples(weights.filter("frame = 8"), "lat", "lon", "weight")
    assert points.filter("name = '00'").first().lat is None and points.select("name").distinct().count() == 24
    some = listed["parts"][-1]
    cut.filter(f"NOT (name = '08' AND part = '{some}')").write.partitionBy("name", "part").text(str(tmp_path / "less"))
    with pytest.raises(Exception, match="parts of frame 08 are missing"):
        tables.read_documents(spark, str(tmp_path / "less")).collect()


def test_frame_lists(spark):
    assert [r.title for r in heatmaps.weekday_frames(spark).orderBy("frame").collect()][0::6] == ["Monday", "Sunday"]
    assert tuples(heatmaps.listed_frames(spark, ["a", "b"])) == [(0, "a", "00"), (1, "b", "01")]
    assert tuples(heatmaps.single_frame(spark, "All", "all")) == [(0, "All", "all")]

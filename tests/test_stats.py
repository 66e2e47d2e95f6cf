import random

import numpy as np
import pytest

from conftest import at, tuples
from kerbside.operators import heatmaps, stats
from kerbside.operators import quantiles as q

SERIES = {
    "uniform": [random.Random(1).uniform(-5, 5) for _ in range(997)],
    "hot_value": [7.0] * 400 + [random.Random(2).uniform(0, 10) for _ in range(800)],
    "outlier": [random.Random(3).uniform(0, 1) for _ in range(500)] + [1e9, -1e9],
    "constant": [4.0] * 50,
    "single": [3.5],
    "pair": [1.0, 2.0],
    "whole": [float(random.Random(4).randrange(30)) for _ in range(640)],
}


@pytest.fixture(scope="module")
def quantiles(spark):
    rows = [(m, v) for m, vs in SERIES.items() for v in vs]
    df = spark.createDataFrame(rows, "measure string, value double")
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    return probabilities, {(r.measure, r.probability): r.quantile for r in stats.exact_quantiles(df, probabilities).collect()}


@pytest.mark.parametrize("measure", SERIES)
def test_quantiles_are_exact(quantiles, measure):
    probabilities, got = quantiles
    for p in probabilities:
        assert got[measure, p] == pytest.approx(np.quantile(SERIES[measure], p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("value", [
    "cast(id as double)", "if(id = 0, 1e15, id / 7.0)", "if(id = 0, -1e15, exp(-id / 900.0))", "if(id % 3 = 0, 5.0, id * 1.0)"])
def test_only_small_intervals_are_ordered(spark, value):
    long = spark.range(200_000).selectExpr("'m' as measure", f"{value} as value")
    counts = q.value_counts(long)
    data = np.sort([r.value for r in long.collect()])
    ranks = [0, 1, 49_999, 50_000, 100_000, 150_001, 199_998, 199_999]
    intervals = q.intervals_of_ranks(counts, {"m": ranks}, small=500)
    assert sorted(p for *_, held in intervals for p in held) == ranks
    for _, low, high, before, held in intervals:
        inside = data[(data >= low) & (data <= high)]
        assert len(set(inside)) <= 500 and before == np.sum(data < low)
        assert all(before <= p < before + len(inside) for p in held)
    got = {r.probability: r.quantile for r in q.quantiles(counts, (0.0, 0.25, 0.5, 0.9999, 1.0)).collect()}
    for p, found in got.items():
        assert found == pytest.approx(np.quantile(data, p), rel=1e-12)


def test_moments_of_large_values(spark):
    data = [1e9 + k for k in range(5)] * 3
    df = spark.createDataFrame([(v, None) for v in data], "a double, b double")
    got = stats.describe(df, ["a", "b"]).collect()
    assert [r.measure for r in got] == ["a"]  # a measure without values has no row
    assert (got[0]["count"], got[0]["mean"], got[0]["std"]) == (15, 1e9 + 2, pytest.approx(np.std(data, ddof=1)))
    assert stats.describe(df.limit(0), ["a"]).count() == 0


def test_describe_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 5), (None, 6), (3.0, None)], "a double, b int")
    got = {r.measure: r for r in stats.describe(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["q25"], got["a"]["max"]) == (2, 2.0, 1.5, 3.0)
    assert (got["b"]["count"], got["b"]["min"], got["b"]["q50"]) == (2, 5.0, 5.5)


def test_audit_and_counts(spark):
    df = spark.createDataFrame(
        [(0.0, -73.9, 40.7, 0.0, 0.0), (100.0, -70.0, 40.0, -73.9, 40.7), (5.0, -80.0, 50.0, -73.9, 40.7), (-1.0, None, None, None, None)],
        "Trip_Distance double, Start_Lon double, Start_Lat double, End_Lon double, End_Lat double")
    assert tuples(stats.outlier_audit(df)) == [(4, 3, 2, 2, 1, 1)]
    assert [tuple(r) for r in stats.distance_outliers(df).collect()] == [(-1.0, 1), (0.0, 1), (100.0, 1)]


def test_histograms(spark):
    df = spark.createDataFrame([(at("2014-01-05 23:00:00"),), (at("2014-01-06 23:30:00"),)], "t timestamp")
    assert tuples(stats.time_histograms(df, "t")) == [
        ("hour", 23, 2), ("month", 1, 2), ("weekday", 0, 1), ("weekday", 6, 1), ("year", 2014, 2)]


def test_events_per_day_and_month(spark):
    df = spark.createDataFrame(
        [("a", at("2014-01-05 23:00:00")), ("b", at("2014-01-05 01:00:00")), ("c", at("2014-02-05 01:00:00"))],
        "guid string, start_date timestamp")
    assert tuples(stats.average_events_per_day(df)) == [(1.5,)]
    assert tuples(stats.events_per_month(df)) == [(2014, 1, 2), (2014, 2, 1)]


def test_weights_share_one_maximum(spark):
    t = [at("2014-01-06 08:00:00"), at("2014-01-07 09:00:00")]
    rows = [(t[0], -73.9901, 40.7001)] * 4 + [(t[1], -73.9904, 40.6999), (t[1], -75.0, 55.0)]
    points = heatmaps.pickup_points(spark.createDataFrame(rows, "Pickup_Time timestamp, Start_Lon double, Start_Lat double"))
    assert tuples(heatmaps.pickup_heatmap(points, heatmaps.frame_weekday)) == [
        (0, 40.7, -73.99, 4, 1.0), (1, 40.7, -73.99, 1, 0.25)]
    assert tuples(heatmaps.pickup_heatmap(points), "pickups", "weight") == [(5, 1.0)]
    assert tuples(heatmaps.same_hour_days(points, [t[1].date(), t[0].date()], 9)) == [(0, 40.7, -73.99, 1, 1.0)]
    assert tuples(heatmaps.weekday_slice(points, 1, 9), "frame", "weight") == [(7, 1.0)]


def test_event_weights(spark):
    rows = [(at("2014-01-06 08:00:00"), -1.0, 38.5, -122.5), (at("2014-01-06 08:30:00"), 2.0, 38.5, -122.0), (at("2014-01-06 09:00:00"), 9.0, None, 1.0)]
    points = heatmaps.event_points(spark.createDataFrame(rows, "start_date timestamp, score double, latitude double, longitude double"))
    assert tuples(heatmaps.event_heatmap(points, heatmaps.frame_hour), "frame", "lon", "score", "weight") == [
        (8, -122.0, 2.0, 2.0), (8, -122.5, 0.0, 1.0)]

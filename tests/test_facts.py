from pyspark.sql import functions as F
from datetime import date, datetime

from conftest import at, tuples
from kerbside.operators import facts, sampling, stats

TRIPS = ("Pickup_Time timestamp, Dropoff_Time timestamp, Start_Lon double, Start_Lat double, "
         "End_Lon double, End_Lat double")
NAN = float("nan")


def trips(spark, *rows):
    return spark.createDataFrame(list(rows), TRIPS)


def test_each_end_counts_on_its_own(spark):
    df = facts.district_hours(trips(
        spark,
        (at("2014-12-31 23:50:00"), at("2015-01-01 00:10:00"), -73.99, 40.74, -73.98, 40.75),
        (at("2014-12-31 23:59:59"), at("2015-01-01 00:20:00"), 0.0, 0.0, -73.98, 40.75),
        (at("2014-12-31 23:00:00"), at("2015-01-01 01:00:00"), -73.99, 40.74, None, NAN),
        (at("2014-12-31 23:00:00"), at("2015-01-01 01:00:00"), 0.0, 0.0, NAN, 40.75),
    ))
    assert tuples(df) == [
        (at("2014-12-31 23:00:00"), 40.74, -73.99, 2, 0),
        (at("2015-01-01 00:00:00"), 40.75, -73.98, 0, 2),
    ]


def test_pickups_and_dropoffs_share_a_row(spark):
    t = at("2014-05-05 10:30:00")
    df = facts.district_hours(trips(spark, (t, t, -73.99, 40.74, -73.99, 40.74)))
    assert tuples(df) == [(at("2014-05-05 10:00:00"), 40.74, -73.99, 1, 1)]


def test_bounds_are_inclusive(spark):
    t = at("2014-05-05 10:30:00")
    df = facts.district_hours(trips(
        spark, (t, t, -80.0, 40.0, -70.0, 50.0), (t, t, -80.001, 40.0, -69.999, 50.0), (t, t, -75.0, 39.999, -75.0, 50.001)))
    assert tuples(df, "Lat", "Lon", "Pickup_Count", "Dropoff_Count") == [(40.0, -80.0, 1, 0), (50.0, -70.0, 0, 1)]


def test_halves_round_away_from_zero(spark):
    t = at("2014-05-05 10:30:00")
    df = facts.district_hours(trips(
        spark, (t, t, -73.985, 40.745, -73.984999, 40.744999), (t, t, -73.994999999, 40.735, 0.0, 0.0)))
    assert tuples(df, "Lat", "Lon", "Pickup_Count", "Dropoff_Count") == [
        (40.74, -73.98, 0, 1), (40.74, -73.99, 1, 0), (40.75, -73.99, 1, 0)]


def test_one_scan_one_shuffle_before_counting(spark):
    t = at("2014-05-05 10:30:00")
    plan = facts.district_hours(trips(spark, (t, t, -73.99, 40.74, -73.99, 40.74)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Python" not in plan


FACTS = "Time timestamp, Lat double, Lon double, Pickup_Count bigint, Dropoff_Count bigint"


def test_split_hour_belongs_to_the_later_part(spark):
    df = spark.createDataFrame([(at(f"2014-12-31 23:00:00"), 1), (at("2015-01-01 00:00:00"), 2), (at("2015-01-01 01:00:00"), 3)],
                               "Time timestamp, n int")
    split = datetime(2015, 1, 1)
    before, after = facts.split_by_time(df, split)
    assert tuples(before, "n") == [(1,)] and tuples(after, "n") == [(2,), (3,)]
    before, after = facts.split_by_time(df, split, strict_reference=True)
    assert tuples(before, "n") == [(1,)] and tuples(after, "n") == [(3,)]


def test_top_sample_and_listed_districts(spark):
    t = at("2014-05-05 10:00:00")
    rows = [(t, 40.70 + i / 100, -73.99, 10 - i, 0) for i in range(6)] + [(t, 41.0, -73.99, 10, 0)]
    df = spark.createDataFrame(rows, FACTS)
    assert [(r.Lat, r.Pickups) for r in facts.top_districts(df, 3).collect()] == [(40.70, 10), (41.0, 10), (40.71, 9)]
    drawn = tuples(facts.sample_districts(df, n=2, among=4))
    assert len(drawn) == 2 and drawn == tuples(facts.sample_districts(df.repartition(5), n=2, among=4))
    listed = spark.createDataFrame([(40.71, -73.99), (40.71, -73.99), (12.0, 3.0)], "Lat double, Lon double")
    assert tuples(facts.of_districts(df, listed), "Lat", "Pickup_Count") == [(40.71, 9)]


def test_day_slice_is_closed(spark):
    df = spark.createDataFrame([(at(f"2013-10-{d} {h}"), ) for d in (27, 28, 29) for h in ("00:00:00", "23:59:59")], "t timestamp")
    got = tuples(stats.date_slice(df, "t", date(2013, 10, 28), date(2013, 10, 28)))
    assert got == [(at("2013-10-28 00:00:00"),), (at("2013-10-28 23:59:59"),)]


def test_keyed_sample_ignores_layout(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    one = tuples(sampling.bernoulli_by_key(df, ["k"], 0.1, 5))
    assert one == tuples(sampling.bernoulli_by_key(df.repartition(13), ["k"], 0.1, 5))
    assert 1800 < len(one) < 2200
    assert one != tuples(sampling.bernoulli_by_key(df, ["k"], 0.1, 6))


def test_percentage_samples(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("k"), F.lit("x").alias("a b"))
    df.coalesce(3).write.parquet(str(tmp_path / "rows"))
    scan = spark.read.parquet(str(tmp_path / "rows"))
    for draw in (sampling.bernoulli, sampling.bernoulli_rows):
        one = tuples(draw(scan, 5.0, 1))
        assert 800 < len(one) < 1200 and draw(scan, 5.0, 1).columns == ["k", "a b"]
        assert one != tuples(draw(scan, 5.0, 2)) and len(set(one)) < len(one)
        assert draw(scan, 100.0, 1).count() == 20_000 and draw(scan, 0.0, 1).count() == 0
        assert one == tuples(draw(scan if draw is sampling.bernoulli else scan.repartition(13), 5.0, 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert tuples(sampling.bernoulli(spark.read.parquet(str(tmp_path / "rows")), 5.0, 1)) == tuples(sampling.bernoulli(scan, 5.0, 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

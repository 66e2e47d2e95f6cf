import math
from datetime import timedelta

from conftest import at, tuples
from kerbside.operators import errors

SCORED = "Time timestamp, Lat double, Lon double, prediction double, label double"


def scored(spark, *rows):
    return spark.createDataFrame([(at(t), 40.7, -74.0, p, y) for t, p, y in rows], SCORED)


def test_proportional_error_without_division_by_zero(spark):
    df = errors.hourly_errors(scored(spark, ("2015-01-05 00:00:00", 3.0, 0.0), ("2015-01-05 01:00:00", 3.0, 4.0)))
    assert tuples(df, "absolute_error", "squared_error", "proportional_error", "squared_proportional_error") == [
        (1.0, 1.0, 0.25, 0.0625), (3.0, 9.0, 3.0, 9.0)]


def test_district_errors(spark):
    df = errors.district_errors(scored(spark, ("2015-01-05 00:00:00", 3.0, 0.0), ("2015-01-05 01:00:00", 3.0, 4.0)))
    r = df.first()
    assert (r.mse, r.mspe, r.mpe) == (5.0, 4.53125, 1.625)
    assert math.isclose(r.rmse, 5 ** 0.5) and math.isclose(r.rmspe, 4.53125 ** 0.5)


def test_extremes_and_ties(spark):
    # days 5 and 7 are equally good, days 6 and 8 equally bad: the earlier one is named
    df = scored(spark, *[(f"2015-01-{d:02d} 03:00:00", p, 10.0) for d, p in ((5, 9.0), (6, 1.0), (7, 11.0), (8, 19.0))])
    assert tuples(errors.best_and_worst_days(df), "best_day", "worst_day") == [(5, 6)]
    assert tuples(errors.rows_of_extremes(df, "day"), "kind", "day", "prediction") == [("best", 5, 9.0), ("worst", 6, 1.0)]


def test_years_do_not_merge(spark):
    df = scored(spark, ("2014-03-01 03:00:00", 9.0, 10.0), ("2015-03-01 03:00:00", 1.0, 10.0), ("2015-03-02 03:00:00", 9.0, 10.0),
                ("2021-01-02 03:00:00", 5.0, 10.0), ("2021-03-03 03:00:00", 9.0, 10.0))
    assert tuples(errors.daily_errors(df), "year", "day", "mpe") == [
        (2014, 60, 0.1), (2015, 60, 0.9), (2015, 61, 0.1), (2021, 2, 0.5), (2021, 62, 0.1)]
    assert {(r.year, r.week) for r in errors.weekly_errors(df).collect()} == {(2014, 9), (2015, 9), (2015, 10), (2020, 53), (2021, 9)}
    assert tuples(errors.best_and_worst_days(df), "best_year", "best_day", "worst_year", "worst_day") == [(2014, 60, 2015, 60)]
    assert tuples(errors.rows_of_extremes(df, "day"), "kind", "year", "day", "prediction") == [
        ("best", 2014, 60, 9.0), ("worst", 2015, 60, 1.0)]


def test_weeks_at_the_turn_of_the_year_are_left_out(spark):
    start = at("2015-01-01 00:00:00")
    rows = [(str(start + timedelta(days=d)), 10.0 + (50 if d in (0, 364) else d % 11), 10.0) for d in range(365)]
    df = scored(spark, *rows)
    assert {1, 53} <= {r.week for r in errors.weekly_errors(df).collect()}
    r = errors.best_and_worst_weeks(df).first()
    assert r.best_week not in (1, 53) and r.worst_week not in (1, 53)


def test_daily_table_and_comparison(spark):
    df = scored(spark, ("2015-02-01 00:00:00", 1.0, 2.0), ("2015-02-01 05:00:00", 3.0, 4.0), ("2015-02-02 00:00:00", 1.0, 1.0))
    assert tuples(errors.daily_mean_label(df), "day", "mean_label") == [(32, 3.0), (33, 1.0)]
    assert tuples(errors.comparison(errors.daily_errors(df)), "day", "mpe_scaled", "rmse") == [(32, 750.0, 1.0), (33, 0.0, 0.0)]


def test_spread_over_districts(spark):
    df = spark.createDataFrame([(1.0, 0.1), (3.0, 0.3)], "rmse double, mpe double")
    r = errors.error_spread(df).first()
    assert (r.districts, r.rmse_mean) == (2, 2.0) and math.isclose(r.rmse_std, 2 ** 0.5) and math.isclose(r.mpe_mean, 0.2)

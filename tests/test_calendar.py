from datetime import date, datetime, timedelta

from conftest import at, tuples
from kerbside.functions import timeparts as tp
from kerbside.functions import values
from pyspark.sql import functions as F


def nth(year, month, weekday, n):
    days = [d for i in range(31) if (d := date(year, month, 1) + timedelta(days=i)).month == month and d.weekday() == weekday]
    return days[n]


def us_holidays(year, observed):
    fixed = [date(year, 1, 1), date(year, 7, 4), date(year, 11, 11), date(year, 12, 25)]
    fixed += [date(year, 6, 19)] if year >= 2021 else []  # signed into law that year
    days = {nth(year, 1, 0, 2), nth(year, 2, 0, 2), nth(year, 5, 0, -1), nth(year, 9, 0, 0), nth(year, 10, 0, 1),
            nth(year, 11, 3, 3), *fixed}
    if observed:
        for d in [*fixed, date(year + 1, 1, 1)]:
            shift = {5: -1, 6: 1}.get(d.weekday(), 0)
            if (d + timedelta(days=shift)).year == year:
                days.add(d + timedelta(days=shift))
    return days


def test_holidays_of_all_years(spark):
    df = spark.sql("select explode(sequence(date'2009-01-01', date'2025-12-31')) as d")
    for observed in (True, False):
        got = {r.d for r in df.filter(tp.is_holiday(F.col("d"), observed)).collect()}
        assert got == set().union(*[us_holidays(y, observed) for y in range(2009, 2026)])


def test_calendar_columns(spark):
    df = spark.createDataFrame([(at("2012-12-31 17:00:00"),)], "Time timestamp")
    r = tp.with_calendar(df, month_and_day=True).first()
    assert (r.Hour, r.Day_Of_Week, r.Day_Of_Year, r.Is_Holiday, r.Month, r.Day) == (17, 0, 366, False, 12, 31)


def test_hour_range_and_last_day(spark):
    assert tp.full_calendar(strict_reference=True).hours == 61321
    full = tp.full_calendar()
    assert full.hours == 61344 and full.days == 2556
    hours = tp.HourRange(datetime(2015, 3, 8, 0), datetime(2015, 3, 8, 23)).table(spark)
    assert sorted(r.Time.hour for r in hours.collect()) == list(range(24))  # no hole on a clock-change day


def test_parsing(spark):
    df = spark.createDataFrame([("2014-07-04T23:59:59-0400", "20140704", "20140704 23:45")], "iso string, d string, m string")
    r = df.select(tp.iso_prefix(F.col("iso")), tp.compact_date(F.col("d")), tp.compact_minute(F.col("m"))).first()
    assert tuple(r) == (at("2014-07-04 23:59:59"), date(2014, 7, 4), at("2014-07-04 23:45:00"))


def test_numbers_and_sentinels(spark):
    df = spark.createDataFrame([("1.5",), (" -2 ",), ("x",), ("",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(values.number_or_null(F.col("t"))).collect()] == [1.5, -2.0, None, None, None, None]
    df = spark.createDataFrame([(-9999,), (0,), (None,)], "v int")
    assert [r[0] for r in df.select(values.sentinel_to_null(F.col("v"))).collect()] == [None, 0.0, None]

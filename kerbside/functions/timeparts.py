"""Hours, calendar parts, and public holidays as column expressions."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS_PER_HOUR = 3600

# Labels of heatmap frames, Monday first.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def hour_of(t: Column) -> Column:
    """Timestamp with minutes and seconds discarded."""
    return F.date_trunc("hour", t.cast("timestamp"))


def hour_index(t: Column) -> Column:
    """Hours since the epoch, the integer that time windows are ordered by."""
    return F.floor(F.unix_timestamp(t.cast("timestamp")) / SECONDS_PER_HOUR).cast("bigint")


def hour_from_index(ix: Column) -> Column:
    return F.timestamp_seconds(ix * SECONDS_PER_HOUR)


def plus_hours(t: Column, hours: int) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(hours))


def compact_date(x: Column) -> Column:
    """``20150131`` (number or text) as a date."""
    return F.to_date(x.cast("string"), "yyyyMMdd")


def compact_minute(x: Column) -> Column:
    """``20150131 17:00`` as a timestamp."""
    return F.to_timestamp(x, "yyyyMMdd HH:mm")


def iso_prefix(x: Column) -> Column:
    """First 19 characters of an ISO text; an offset behind them is dropped on purpose."""
    return F.to_timestamp(F.substring(x, 1, 19), "yyyy-MM-dd'T'HH:mm:ss")


def weekday_ix(t: Column) -> Column:
    """Monday is 0."""
    return F.weekday(t).cast("int")


def weekday_label(ix: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), (ix + 1).cast("int"))


def hour_label(ix: Column) -> Column:
    return F.format_string("%02d:00", ix.cast("int"))


def _monday_between(d: Column, month: int, first: int, last: int) -> Column:
    return _weekday_between(d, 0, month, first, last)


def _weekday_between(d: Column, weekday: int, month: int, first: int, last: int) -> Column:
    return (F.month(d) == month) & (F.weekday(d) == weekday) & F.dayofmonth(d).between(first, last)


def _on(d: Column, month: int, day: int) -> Column:
    return (F.month(d) == month) & (F.dayofmonth(d) == day)


def is_holiday(day: Column, observed: bool = True) -> Column:
    """US federal holidays by rule, so that no calendar table has to be joined.

    With ``observed`` a fixed-date holiday falling on a Saturday also frees the Friday
    before, and one falling on a Sunday the Monday after.
    """
    d = F.to_date(day)
    floating = [
        _monday_between(d, 1, 15, 21),        # third Monday of January
        _monday_between(d, 2, 15, 21),        # third Monday of February
        _monday_between(d, 5, 25, 31),        # last Monday of May
        _monday_between(d, 9, 1, 7),          # first Monday of September
        _monday_between(d, 10, 8, 14),        # second Monday of October
        _weekday_between(d, 3, 11, 22, 28),   # fourth Thursday of November
    ]
    # Month, day, and the year of the first observance.
    fixed = [(1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)]

    def falls(day: Column, m: int, n: int, since: int) -> Column:
        return _on(day, m, n) & (F.year(day) >= since)

    rules = floating + [falls(d, *f) for f in fixed]
    if observed:
        next_day, previous_day = F.date_add(d, 1), F.date_sub(d, 1)
        rules += [(F.weekday(d) == 4) & falls(next_day, *f) for f in fixed]
        rules += [(F.weekday(d) == 0) & falls(previous_day, *f) for f in fixed]
    return reduce(lambda a, b: a | b, rules)


def with_calendar(df: DataFrame, time: str = "Time", observed: bool = True,
                  month_and_day: bool = False) -> DataFrame:
    """Add the calendar features of ``time``; ``Month`` and ``Day`` only on request."""
    t = F.col(time)
    parts = {
        "Hour": F.hour(t).cast("int"),
        "Day_Of_Week": weekday_ix(t),
        "Day_Of_Year": F.dayofyear(t).cast("int"),
        "Is_Holiday": is_holiday(t, observed),
    }
    if month_and_day:
        parts |= {"Month": F.month(t).cast("int"), "Day": F.dayofmonth(t).cast("int")}
    return df.withColumns(parts)


class HourRange:
    """A closed range of hours. Its length is known while planning, which is what makes
    broadcast decisions about per-hour and per-day relations provable."""

    def __init__(self, first: datetime, last: datetime):
        if last < first:
            raise ValueError("calendar ends before it starts")
        self.first = first.replace(minute=0, second=0, microsecond=0)
        self.last = last.replace(minute=0, second=0, microsecond=0)

    @property
    def hours(self) -> int:
        return int((self.last - self.first).total_seconds()) // SECONDS_PER_HOUR + 1

    @property
    def days(self) -> int:
        return (self.last.date() - self.first.date()).days + 1

    def _literal(self, t: datetime) -> Column:
        return F.to_timestamp(F.lit(t.isoformat(" ")))

    @property
    def start(self) -> Column:
        return self._literal(self.first)

    @property
    def end(self) -> Column:
        return self._literal(self.last)

    def contains(self, t: Column) -> Column:
        return t.between(self.start, self.end)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per hour, generated in parallel."""
        ix = F.unix_timestamp(self.start) + F.col("id") * SECONDS_PER_HOUR
        return spark.range(self.hours).select(F.timestamp_seconds(ix).alias("Time"))


def full_calendar(first_year: int = 2009, last_year: int = 2015,
                  strict_reference: bool = False) -> HourRange:
    """Whole years; ``strict_reference`` ends at hour 0 of the last day."""
    last = datetime(last_year, 12, 31, 0 if strict_reference else 23)
    return HourRange(datetime(first_year, 1, 1), last)

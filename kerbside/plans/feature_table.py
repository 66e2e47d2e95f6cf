"""One row per district and hour with every feature a model is trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.timeparts import HourRange, with_calendar
from kerbside.operators import trailing
from kerbside.operators.facts import FACT_KEY
from kerbside.sizing import broadcast_if_bounded


def district_features(
    facts: DataFrame, gaps: str = "drop", hours: Sequence[int] = trailing.HOURS,
) -> DataFrame:
    """Facts with the own, neighbour and city counts of the preceding hours.

    ``gaps="drop"`` keeps a row only if the district itself and some neighbour had
    counts in the preceding hour; ``gaps="zero"`` keeps every row and fills with 0.
    """
    counted = trailing.with_trailing_counts(facts, hours=hours)
    own = [c for c in trailing.trailing_columns(hours) if "_Nyc_" not in c]
    if gaps == "zero":
        return counted.fillna(0, own)
    if gaps != "drop":
        raise ValueError("gaps is 'drop' or 'zero'")
    return counted.filter(" AND ".join(f"{c} IS NOT NULL" for c in own))


def feature_table(
    facts: DataFrame,
    weather: DataFrame | None = None,
    venue_features: DataFrame | None = None,
    calendar: HourRange | None = None,
    gaps: str = "drop",
    observed_holidays: bool = True,
    month_and_day: bool = False,
    hours: Sequence[int] = trailing.HOURS,
) -> DataFrame:
    """Join the counts with calendar, daily weather and venue activity.

    Rows without weather for their day or venue lists for their hour drop out. The
    calendar bounds how many hours and days the joined tables can have: within
    ``sizing.BROADCAST_LIMIT_BYTES`` they are broadcast and the fact rows stay where the
    trailing counts left them; otherwise the join is left to AQE.
    """
    max_hours = calendar.hours if calendar else None
    max_days = calendar.days if calendar else None
    if calendar is not None:
        # earlier rows must stay: the first hours of the calendar look back on them
        facts = facts.filter(F.col("Time") <= calendar.end)

    rows = district_features(facts, gaps, hours)
    city = trailing.city_trailing(facts, hours)
    if calendar is not None:
        rows, city = (d.filter(calendar.contains(F.col("Time"))) for d in (rows, city))
    table = rows.join(broadcast_if_bounded(city, max_hours), "Time", "left" if gaps == "zero" else "inner")
    if gaps == "zero":
        table = table.fillna(0, [c for c in trailing.trailing_columns(hours) if "_Nyc_" in c])
    table = table.select(*FACT_KEY, "Pickup_Count", *trailing.trailing_columns(hours))
    table = with_calendar(table, observed=observed_holidays, month_and_day=month_and_day)
    if weather is not None:
        table = (
            table.withColumn("Date", F.to_date("Time"))
            .join(broadcast_if_bounded(weather, max_days), "Date").drop("Date")
        )
    if venue_features is not None:
        table = table.join(venue_features, "Time")
    return table

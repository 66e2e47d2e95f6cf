"""Error measures of predictions: per row, district, day and week, and the extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.values import proportional_error

DISTRICT = ["Lat", "Lon"]
# Weeks cut by the turn of the year, which the weekly ranking leaves out.
EDGE_WEEKS = (1, 53)


def hourly_errors(scored: DataFrame) -> DataFrame:
    """Adds absolute, squared, proportional and squared proportional error."""
    absolute = F.abs(F.col("label") - F.col("prediction"))
    pe = proportional_error(F.col("prediction"), F.col("label"))
    return scored.withColumns({
        "absolute_error": absolute.cast("double"),
        "squared_error": (absolute * absolute).cast("double"),
        "proportional_error": pe,
        "squared_proportional_error": pe * pe,
    })


def _means(errors: DataFrame, *keys) -> DataFrame:
    mse, mspe = F.avg("squared_error"), F.avg("squared_proportional_error")
    return errors.groupBy(*keys).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        mspe.alias("mspe"), F.sqrt(mspe).alias("rmspe"),
        F.avg("proportional_error").alias("mpe"),
    )


def district_errors(scored: DataFrame) -> DataFrame:
    """``Lat, Lon, mse, rmse, mspe, rmspe, mpe``: one aggregate, combined on the map side."""
    return _means(hourly_errors(scored), *DISTRICT)


def error_spread(per_district: DataFrame) -> DataFrame:
    """Mean and standard deviation of RMSE and MPE over the districts."""
    return per_district.agg(
        F.count("*").alias("districts"),
        F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"),
        F.avg("mpe").alias("mpe_mean"), F.stddev_samp("mpe").alias("mpe_std"),
    )


def with_day(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"year": F.year("Time").cast("int"), "day": F.dayofyear("Time").cast("int")})


def with_week(scored: DataFrame) -> DataFrame:
    """Weeks belong to the year that has most of their days."""
    year = F.extract(F.lit("YEAROFWEEK"), F.col("Time")).cast("int")
    return scored.withColumns({"year": year, "week": F.weekofyear("Time").cast("int")})


def daily_errors(scored: DataFrame) -> DataFrame:
    return _means(with_day(hourly_errors(scored)), *DISTRICT, "year", "day")


def weekly_errors(scored: DataFrame) -> DataFrame:
    return _means(with_week(hourly_errors(scored)), *DISTRICT, "year", "week")


def daily_mean_label(scored: DataFrame) -> DataFrame:
    return with_day(scored).groupBy(*DISTRICT, "year", "day").agg(F.avg("label").alias("mean_label"))


def comparison(daily: DataFrame, factor: float = 2000.0) -> DataFrame:
    """Proportional measures scaled to sit beside the RMSE of the same day."""
    return daily.select(*DISTRICT, "year", "day", (F.col("mpe") * factor).alias("mpe_scaled"),
                        (F.col("rmspe") * factor).alias("rmspe_scaled"), "rmse")


def best_and_worst(periods: DataFrame, period: str) -> DataFrame:
    """Per district the period with the lowest and the highest MPE, the earlier one on ties.

    Both come out of one aggregate that keeps a single candidate per task and district.
    """
    at, number = F.struct("year", period), F.col(period)
    found = periods.groupBy(*DISTRICT).agg(
        F.min_by(at, F.struct("mpe", "year", period)).alias("best"),
        F.max_by(at, F.struct(F.col("mpe"), -F.col("year"), -number)).alias("worst"))
    return found.select(*DISTRICT, *[
        F.col(f"{kind}.{part}").alias(f"{kind}_{part}") for kind in ("best", "worst") for part in ("year", period)])


def best_and_worst_days(scored: DataFrame) -> DataFrame:
    return best_and_worst(daily_errors(scored), "day")


def best_and_worst_weeks(scored: DataFrame) -> DataFrame:
    inner = weekly_errors(scored).filter(~F.col("week").isin(*EDGE_WEEKS))
    return best_and_worst(inner, "week")


def rows_of_extremes(scored: DataFrame, period: str) -> DataFrame:
    """The scored rows that fall on each district's best and worst day or week."""
    dated, extremes = {
        "day": (with_day, best_and_worst_days), "week": (with_week, best_and_worst_weeks),
    }[period]
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"{k}_year").alias("year"), F.col(f"{k}_{period}").alias(period))
        for k in ("best", "worst")
    ])
    picked = extremes(scored).select(*DISTRICT, F.inline(kinds))
    return dated(scored).join(picked, [*DISTRICT, "year", period]).select(
        *DISTRICT, "kind", "year", period, "Time", "prediction", "label")

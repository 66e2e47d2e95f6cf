"""The pipeline as command-line jobs: ``python -m kerbside <job> ...``, also under spark-submit.

    trips        trip CSV files          -> district-hour facts
    weather      daily station summaries -> daily weather, gaps filled
    enrich       events, venues, geocodes -> flat events
    events       flat events             -> venue features per hour
    features     the three above         -> feature table
    districts    facts                   -> list of sampled busy districts
    train        feature table           -> one model per listed district
    evaluate     feature table, models   -> predictions and error table
    importance   a saved forest          -> feature scores
    heatmaps     trips, flat events      -> map documents of all series
    sample       any CSV                 -> a percentage of its rows
    slice        trip CSV files          -> trips of a range of days
    sample-years trip CSV files          -> a sample per year, and all merged by position
    report-trips, report-weather, report-events, report-errors
                 trips, observations, flat events, predictions -> tables of counts and statistics
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from kerbside.functions import timeparts as tp
from kerbside.models import forest as forest_nodes
from kerbside.models import prepare as prep
from kerbside.models import linear, score, train
from kerbside.operators import enrichment, errors, facts, heatmaps, sampling, stats, venues, weather
from kerbside.plans.feature_table import feature_table
from kerbside.session import build_session, materialize, own_tables
from kerbside.sources import events as event_files
from kerbside.sources import tables
from kerbside.sources import trips as trip_files
from kerbside.sources import weather as weather_files


def _trips(spark: SparkSession, a: argparse.Namespace, positions=trip_files.TRIP_POSITIONS) -> DataFrame:
    return trip_files.read_trips(spark, _paths(spark, a), positions)


def _calendar(a: argparse.Namespace) -> tp.HourRange:
    return tp.full_calendar(a.first_year, a.last_year, a.strict_reference)


def run_trips(spark, a) -> None:
    tables.write_by_month(facts.district_hours(_trips(spark, a)), a.out)


def run_weather(spark, a) -> None:
    header = weather_files.read_header(spark, a.observations)
    raw = weather_files.read_daily(spark, a.observations, header)
    days = materialize(weather.station_days(raw), "station-days")
    numbers = materialize(weather.station_numbers(days), "station-numbers")
    weather.weather_arrays(days, numbers).write.parquet(f"{a.out}/days")
    numbers.write.parquet(f"{a.out}/stations")


def run_enrich(spark, a) -> None:
    flat = enrichment.enrich_events(
        event_files.read_events(spark, a.events, not a.json_lines).drop("venue"),
        event_files.read_venues(spark, a.venues, not a.json_lines),
        event_files.read_geocodes(spark, a.geocodes), a.strict_reference)
    event_files.write_flat(flat, a.out)


def run_events(spark, a) -> None:
    spans = materialize(venues.event_spans(event_files.read_flat(spark, a.events)), "spans")
    ids = venues.venue_ids(spans)
    activity = venues.venue_hours(spans, ids, _calendar(a))
    venues.venue_features(activity, _calendar(a)).write.parquet(f"{a.out}/features")
    ids.write.parquet(f"{a.out}/venues")


def run_features(spark, a) -> None:
    lists = spark.read.parquet(f"{a.events}/features")
    width = spark.read.parquet(f"{a.events}/venues").count()
    names = weather.station_names(spark.read.parquet(f"{a.weather}/stations"))
    table = feature_table(
        tables.read_by_month(spark, a.facts), prep.weather_vectors(spark.read.parquet(f"{a.weather}/days"), names),
        prep.venue_vectors(lists, width), _calendar(a), gaps=a.gaps, month_and_day=a.month_and_day)
    tables.write_by_month(table, a.out)


def run_districts(spark, a) -> None:
    drawn = facts.sample_districts(tables.read_by_month(spark, a.facts), a.n, a.among, a.seed)
    tables.write_districts(drawn, a.out)


def _prepared(spark, a) -> prep.Prepared:
    is_linear = a.kind == "linear"
    table = tables.read_by_month(spark, a.features)
    return prep.prepare(table, scale=is_linear, one_hot=is_linear, split=a.split, strict_reference=a.strict_reference)


def run_train(spark, a) -> None:
    rows, = train.by_cell(_prepared(spark, a).train)
    listed = tables.district_list(spark, a.districts)
    if a.kind == "linear":
        linear.save(linear.fit_all(train.of_listed(rows, listed)), a.models)
        return
    categorical = not a.numeric_categories
    train.train_districts(
        rows, listed, lambda: train.forest(a.trees, a.depth, a.seed, categorical), a.models, categorical)


def run_evaluate(spark, a) -> None:
    prepared = _prepared(spark, a)
    rows, = train.by_cell(prepared.train if a.train_error else prepared.test)
    listed = tables.district_list(spark, a.districts)
    if a.kind == "linear":
        sampled = score.sampled(train.of_listed(rows, listed), a.fraction)
        found = linear.predict_all(sampled, linear.load(spark, a.models, listed))
    else:
        found = score.score_districts(rows, score.load_models(a.models, a.kind, listed), a.fraction)
    scored = materialize(found, "scored")
    tables.write_predictions(scored, f"{a.out}/predictions")
    tables.write_errors(errors.district_errors(scored), f"{a.out}/errors")


def run_importance(spark, a) -> None:
    splits = forest_nodes.splits_by_level(forest_nodes.saved_nodes(spark, a.model), a.max_level)
    forest_nodes.importance(splits, a.n).write.option("header", True).csv(a.out)


def run_heatmaps(spark, a) -> None:
    pickups = materialize(heatmaps.pickup_points(_trips(spark, a)).select("Time", "lat_cell", "lon_cell"), "points")
    events = heatmaps.event_points(event_files.read_flat(spark, a.events)) if a.events else None
    for name, (weights, frames) in heatmaps.map_series(spark, pickups, events, a.days, a.hour).items():
        tables.write_documents(heatmaps.documents(materialize(weights, name), frames), f"{a.out}/{name}")


def run_sample(spark, a) -> None:
    rows = spark.read.option("header", True).csv(a.csv)
    sampling.bernoulli_rows(rows, a.percentage, a.seed).write.option("header", True).csv(a.out)


def _paths(spark: SparkSession, a: argparse.Namespace) -> str | list[str]:
    return trip_files.listed_paths(spark, a.trips, a.file_list) if a.file_list else a.trips


def run_sample_years(spark, a) -> None:
    lines = sampling.yearly_lines(trip_files.read_lines(spark, _paths(spark, a)), a.seed, a.fraction)
    trip_files.write_lines(lines, f"{a.out}/years")
    trip_files.merge_samples(spark, f"{a.out}/years").write.option("header", True).csv(f"{a.out}/merged")


def _write_reports(reports: Mapping[str, DataFrame], out: str) -> None:
    for name, report in reports.items():
        report.write.option("header", True).csv(f"{out}/{name}")


def run_report_trips(spark, a) -> None:
    trips = _trips(spark, a, trip_files.SAMPLE_POSITIONS)
    _write_reports({
        "histograms": stats.time_histograms(trips, "Pickup_Time"),
        "passengers": stats.value_counts(trips, "Passenger_Count"),
        "odd_distances": stats.distance_outliers(trips),
        "outliers": stats.outlier_audit(trips),
    }, a.out)


def run_report_weather(spark, a) -> None:
    measures = weather_files.DAILY_MEASURES
    header = weather_files.read_header(spark, a.observations)
    present = [m for m in measures if m in header]
    daily = materialize(weather_files.read_daily(spark, a.observations, header, present), "observations")
    per_day = weather.stations_per_day(daily)
    spread = weather.daily_spread(daily, present)
    reports = {
        "measures": stats.describe(daily, present),
        "stations_per_day": per_day,
        "stations_per_day_described": stats.describe(per_day, ["station_count"]),
        "stations_per_month": weather.monthly_station_mean(per_day),
        "station_months": weather.station_month_fraction(daily),
        "daily_std": spread,
        "daily_std_described": stats.describe(spread, present),
    }
    if a.hourly:
        hourly = weather_files.read_hourly(spark, a.hourly)
        reports |= {
            "hourly_precipitation": stats.describe(hourly, ["HPCP"]),
            "hourly_coverage": weather.hourly_coverage(hourly, _calendar(a).table(spark)),
            "measurements_per_hour": weather.measurements_per_hour(hourly),
        }
    _write_reports(reports, a.out)


def run_report_events(spark, a) -> None:
    flat = event_files.read_flat(spark, a.events)
    _write_reports({
        "events_per_month": stats.events_per_month(flat),
        "events_per_day": stats.average_events_per_day(flat),
        "scores": stats.value_counts(flat, "score"),
    }, a.out)


def run_report_errors(spark, a) -> None:
    scored = materialize(tables.read_predictions(spark, a.predictions), "scored")
    daily = errors.daily_errors(scored)
    _write_reports({
        "spread": errors.error_spread(errors.district_errors(scored)),
        "daily": daily,
        "weekly": errors.weekly_errors(scored),
        "daily_mean_label": errors.daily_mean_label(scored),
        "comparison": errors.comparison(daily),
        "best_worst_days": errors.best_and_worst_days(scored),
        "best_worst_weeks": errors.best_and_worst_weeks(scored),
        "rows_of_days": errors.rows_of_extremes(scored, "day"),
        "rows_of_weeks": errors.rows_of_extremes(scored, "week"),
    }, a.out)


def run_slice(spark, a) -> None:
    trips = _trips(spark, a, trip_files.SAMPLE_POSITIONS)
    stats.date_slice(trips, "Pickup_Time", a.first, a.last).write.option("header", True).csv(a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kerbside", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name, run, *positional):
        j = jobs.add_parser(name)
        for arg in positional:
            j.add_argument(arg)
        j.add_argument("--strict-reference", action="store_true",
                       help="reproduce the published pipeline where it departs from its own description")
        j.set_defaults(run=run)
        return j

    def years(j):
        j.add_argument("--first-year", type=int, default=2009)
        j.add_argument("--last-year", type=int, default=2015)

    def model(j):
        j.add_argument("--kind", choices=sorted(score.MODEL_CLASSES), default="random_forest")
        j.add_argument("--split", type=datetime.fromisoformat, default=prep.SPLIT)

    job("trips", run_trips, "trips", "out").add_argument("--file-list")
    j = job("heatmaps", run_heatmaps, "trips", "out")
    j.add_argument("--file-list")
    j.add_argument("--events", help="flat events, for the maps of events")
    j.add_argument("--days", type=date.fromisoformat, nargs="*", default=[], help="days to compare at one hour")
    j.add_argument("--hour", type=int, default=19)
    job("weather", run_weather, "observations", "out")
    job("enrich", run_enrich, "events", "venues", "geocodes", "out").add_argument("--json-lines", action="store_true")
    years(job("events", run_events, "events", "out"))
    j = job("features", run_features, "facts", "weather", "events", "out")
    years(j)
    j.add_argument("--gaps", choices=("drop", "zero"), default="drop")
    j.add_argument("--month-and-day", action="store_true")
    j = job("districts", run_districts, "facts", "out")
    j.add_argument("--n", type=int, default=25)
    j.add_argument("--among", type=int, default=200)
    j.add_argument("--seed", type=int, default=1234)
    j = job("train", run_train, "features", "models", "districts")
    model(j)
    j.add_argument("--trees", type=int, default=5)
    j.add_argument("--depth", type=int, default=15)
    j.add_argument("--numeric-categories", action="store_true",
                   help="take categories as numbers, for districts with fewer rows than categories")
    j.add_argument("--seed", type=int, default=1234)
    j = job("evaluate", run_evaluate, "features", "models", "districts", "out")
    model(j)
    j.add_argument("--fraction", type=float, default=1.0)
    j.add_argument("--train-error", action="store_true")
    j = job("importance", run_importance, "model", "out")
    j.add_argument("--n", type=int, default=20)
    j.add_argument("--max-level", type=int, help="leave out splits below this level")
    j = job("sample", run_sample, "csv", "percentage", "out")
    j.add_argument("--seed", type=int, default=1234)
    j = job("slice", run_slice, "trips", "out")
    j.add_argument("--file-list")
    for end in ("--first", "--last"):
        j.add_argument(end, type=date.fromisoformat, required=True)
    j = job("sample-years", run_sample_years, "trips", "out")
    j.add_argument("--file-list")
    j.add_argument("--fraction", type=float, default=sampling.KEEP_FRACTION)
    j.add_argument("--seed", type=int, default=1234)
    job("report-trips", run_report_trips, "trips", "out").add_argument("--file-list")
    j = job("report-weather", run_report_weather, "observations", "out")
    j.add_argument("--hourly", help="hourly precipitation")
    years(j)
    job("report-events", run_report_events, "events", "out")
    job("report-errors", run_report_errors, "predictions", "out")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.job == "sample":
        a.percentage = float(a.percentage)
    spark = spark or build_session(f"kerbside-{a.job}")
    with own_tables(spark):
        a.run(spark, a)

"""What the plans must not contain, whatever the data."""

import re
from datetime import datetime

import pytest

import __spark_entry__ as contract
from conftest import SF
from kerbside import sizing
from kerbside.functions.timeparts import HourRange, full_calendar
from kerbside.plans.feature_table import feature_table
from kerbside.session import materialize, materialize_all, new_table_path

QUERIES = contract.queries()
TRAINING = {n for n in QUERIES if n.startswith(("forest_", "train_", "onehot_", "scaled_", "predict_"))}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINING))
def test_no_cross_join_and_no_python(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Python|InPandas|ArrowEval", plan)


def test_scans_read_only_what_they_need(spark):
    plan = physical(QUERIES["district_hour_counts"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "ts", "user_id", "value"}
    assert "GreaterThanOrEqual(o_orderdate" in physical(QUERIES["date_slice"](spark, SF))


@pytest.mark.parametrize("name,shuffles", [
    ("district_hour_counts", 1), ("trailing_district", 2), ("trailing_neighbors", 2), ("city_hours", 2),
    ("trip_histograms", 2), ("outlier_audit", 1), ("error_metrics", 3), ("sample_by_key", 0), ("scalar_functions", 0),
])
def test_number_of_shuffles(spark, name, shuffles):
    plan = physical(QUERIES[name](spark, SF))
    assert len(re.findall(r"\bExchange (?:hash|Single|range)", plan)) == shuffles


FACTS = "Time timestamp, Lat double, Lon double, Pickup_Count bigint, Dropoff_Count bigint"


def test_broadcast_needs_a_proven_bound(spark):
    df = spark.range(10)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(sizing.broadcast_if_bounded(df, 1000))
    assert not hinted(sizing.broadcast_if_bounded(df, None))
    assert not hinted(sizing.broadcast_if_bounded(df, 10 ** 9))
    text = df.selectExpr("cast(id as string) as s")
    assert not hinted(sizing.broadcast_if_bounded(text, 10))
    assert sizing.row_width(df.schema) == 32 and sizing.row_width(text.schema) is None


def test_city_is_broadcast_only_under_a_calendar(spark):
    facts = spark.createDataFrame([], FACTS)
    hint = lambda cal: "strategy=broadcast" in feature_table(facts, calendar=cal)._jdf.queryExecution().optimizedPlan().toString()
    assert hint(full_calendar())
    assert not hint(None)
    assert not hint(HourRange(datetime(1, 1, 1), datetime(9999, 1, 1)))


def test_shared_tables(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as k")
    back = materialize_all({"a": df, "b": df.filter("k = 0")}, partition_by=("k",))
    assert back["a"].count() == 100 and back["b"].count() == 34
    assert back["a"].columns == ["id", "k"] or set(back["a"].columns) == {"id", "k"}
    one = materialize(df, "one")
    assert "Scan" in physical(one) and "Range" not in physical(one)
    assert new_table_path(spark, "x") != new_table_path(spark, "x")
    assert new_table_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

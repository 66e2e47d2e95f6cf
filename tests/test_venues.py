import random
from datetime import timedelta

from conftest import at, tuples
from kerbside.functions.timeparts import HourRange
from kerbside.operators import venues

EVENTS = "start_date timestamp, end_date timestamp, latitude double, longitude double"
CAL = HourRange(at("2014-01-01 00:00:00"), at("2014-01-02 23:00:00"))


def hour(h):
    return CAL.first + timedelta(hours=h)


def events(spark, *rows):
    """Rows of (first hour, last hour, lat, lon)."""
    return spark.createDataFrame(
        [(hour(a) + timedelta(minutes=20), hour(b) + timedelta(minutes=5), la, lo) for a, b, la, lo in rows], EVENTS)


def activity(spark, *rows, calendar=CAL):
    spans = venues.event_spans(events(spark, *rows))
    return venues.venue_hours(spans, venues.venue_ids(spans), calendar)


def test_both_ends_count_and_reversed_spans_vanish(spark):
    got = tuples(activity(spark, (3, 5, 1.0, 1.0), (5, 5, 1.0, 1.0), (9, 8, 1.0, 1.0), (7, 7, None, 1.0)))
    assert got == [(hour(3), 0, 1), (hour(4), 0, 1), (hour(5), 0, 2)]


def test_hours_outside_the_calendar_are_dropped(spark):
    got = tuples(activity(spark, (-5, 1, 1.0, 1.0), (47, 90, 1.0, 1.0), (60, 61, 1.0, 1.0)), "Time")
    assert got == [(hour(0),), (hour(1),), (hour(47),)]


def test_venue_numbers_follow_the_coordinates(spark):
    r = random.Random(1)
    places = {(r.randrange(-300, 300) / 1000, r.randrange(-300, 300) / 1000) for _ in range(300)}
    rows = [(0, 0, la, lo) for la, lo in places for _ in range(r.randrange(1, 3))]
    got = venues.venue_ids(events(spark, *rows)).collect()
    assert [(v.latitude, v.longitude) for v in sorted(got, key=lambda v: v.venue_id)] == sorted(places)
    assert sorted(v.venue_id for v in got) == list(range(len(places)))


def test_dense_hours(spark):
    dense = venues.dense_venue_hours(activity(spark, (3, 3, 2.0, 1.0), (3, 3, 1.0, 1.0), (3, 3, 2.0, 1.0)), CAL)
    rows = {r.Time: [tuple(e) for e in r.Venues] for r in dense.collect()}
    assert len(rows) == 48 and rows[hour(3)] == [(0, 1), (1, 2)] and rows[hour(4)] == []


def test_offsets_look_ahead_with_a_minus(spark):
    table = venues.venue_features(activity(spark, (10, 10, 1.0, 1.0)), CAL)
    rows = {r.Time: r for r in table.collect()}
    assert set(rows) == {hour(h) for h in range(3, 45)}  # the first and last three hours drop out
    for i in venues.OFFSETS:
        # the event shows in column i of the hour i hours later
        assert [tuple(e) for e in rows[hour(10 + i)][f"Venues_{i}h"]] == [(0, 1)]
        assert rows[hour(10 + i)]["Venues_0h"] == ([] if i else rows[hour(10)]["Venues_0h"])
    assert table.columns == ["Time"] + [f"Venues_{i}h" for i in (0, -3, -2, -1, 1, 2, 3)]


def test_long_and_list_form_agree(spark):
    r = random.Random(2)
    rows = [(h := r.randrange(40), h + r.randrange(4), float(r.randrange(3)), 1.0) for _ in range(80)]
    act = activity(spark, *rows)
    long = {}
    for x in venues.shifted_activity(act).collect():
        for i in venues.OFFSETS:
            if x[f"Venues_{i}h"]:
                long.setdefault((x.Time, i), []).append((x.venue_id, x[f"Venues_{i}h"]))
    for x in venues.venue_features(act, CAL).collect():
        for i in venues.OFFSETS:
            assert [tuple(e) for e in x[f"Venues_{i}h"]] == sorted(long.get((x.Time, i), []))

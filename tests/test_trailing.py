"""Trailing counts against a brute-force count in Python."""

import random
from datetime import timedelta

import pytest

from conftest import at, tuples
from kerbside.operators import trailing
from kerbside.plans.feature_table import district_features, feature_table

FACTS = "Time timestamp, Lat double, Lon double, Pickup_Count bigint, Dropoff_Count bigint"
START = at("2014-01-01 00:00:00")


def facts(spark, cells):
    """``cells``: {(hour, lat_cell, lon_cell): (pickups, dropoffs)}."""
    rows = [(START + timedelta(hours=h), la / 100, lo / 100, p, d) for (h, la, lo), (p, d) in cells.items()]
    return spark.createDataFrame(rows, FACTS)


def random_cells(seed, n, lats, lons, hours):
    r = random.Random(seed)
    return {(r.randrange(hours), r.randrange(*lats), r.randrange(*lons)): (r.randrange(9), r.randrange(9)) for _ in range(n)}


def expected(cells, hours, around):
    out = {}
    for h, la, lo in cells:
        sums = []
        for back in hours:
            hits = [
                cells[k] for i in range(1, back + 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)
                if ((dy, dx) != (0, 0)) == around and (k := (h - i, la + dy, lo + dx)) in cells
            ]
            sums += [sum(x[0] for x in hits), sum(x[1] for x in hits)] if hits else [None, None]
        out[START + timedelta(hours=h), la / 100, lo / 100] = tuple(sums)
    return out


@pytest.mark.parametrize("tile,block", [(2, 4), (3, 5), (16, 168)])
def test_matches_brute_force_across_tiles_and_blocks(spark, tile, block):
    cells = random_cells(tile, 900, (4068, 4078), (-7405, -7396), 40)
    df = trailing.with_trailing_counts(facts(spark, cells), tile=tile, block=block)
    names = [f"{c}_{{}}_{h}h" for h in (1, 4) for c in ("Pickup_Count", "Dropoff_Count")]
    rows = df.collect()
    assert len(rows) == len(cells)
    own, near = expected(cells, (1, 4), False), expected(cells, (1, 4), True)
    for r in rows:
        key = (r.Time, r.Lat, r.Lon)
        assert tuple(r[n.format("Dis")] for n in names) == own[key]
        assert tuple(r[n.format("Nb")] for n in names) == near[key]


def test_without_neighbours(spark):
    cells = random_cells(3, 400, (4070, 4073), (-7402, -7399), 60)
    rows = trailing.with_trailing_counts(facts(spark, cells), hours=(2,), neighbours=False, tile=2, block=6).collect()
    own = expected(cells, (2,), False)
    assert {(r.Time, r.Lat, r.Lon): (r.Pickup_Count_Dis_2h, r.Dropoff_Count_Dis_2h) for r in rows} == own


def test_cells_across_the_zero_lines(spark):
    cells = random_cells(9, 300, (-3, 3), (-3, 3), 10)
    rows = trailing.with_trailing_counts(facts(spark, cells), hours=(1,), tile=2, block=4).collect()
    near = expected(cells, (1,), True)
    assert {(r.Time, r.Lat, r.Lon): (r.Pickup_Count_Nb_1h, r.Dropoff_Count_Nb_1h) for r in rows} == near


def test_current_hour_is_excluded_and_short_history_kept(spark):
    df = facts(spark, {(0, 1, 1): (5, 6), (1, 1, 1): (7, 8), (6, 1, 1): (9, 9)})
    got = tuples(trailing.with_trailing_counts(df, neighbours=False), "Pickup_Count", "Pickup_Count_Dis_1h", "Pickup_Count_Dis_4h")
    assert got == [(5, None, None), (7, 5, 5), (9, None, None)]


def test_windows_must_fit_a_block(spark):
    with pytest.raises(ValueError):
        trailing.with_trailing_counts(facts(spark, {(0, 1, 1): (1, 1)}), hours=(9,), block=8)


def test_city_counts(spark):
    cells = random_cells(5, 60, (4070, 4073), (-7402, -7399), 30)
    df = facts(spark, cells)
    per_hour = {}
    for (h, _, _), (p, _) in cells.items():
        per_hour[h] = per_hour.get(h, 0) + p
    want = {}
    for h in range(35):
        for back in (1, 4):
            hits = [per_hour[h - i] for i in range(1, back + 1) if h - i in per_hour]
            want[h, back] = sum(hits) if hits else None
    rows = trailing.city_trailing(df).collect()
    got = {int((r.Time - START).total_seconds()) // 3600: r for r in rows}
    assert {h for h in got} == {h for h in range(35) if want[h, 4] is not None}
    for h, r in got.items():
        assert (r.Pickup_Count_Nyc_1h, r.Pickup_Count_Nyc_4h) == (want[h, 1], want[h, 4])


def test_sums_agree_with_each_other(spark):
    cells = random_cells(6, 300, (4070, 4076), (-7402, -7396), 30)
    df = facts(spark, cells)
    city = {r.Time: r.Pickup_Count_Nyc for r in trailing.city_hours(df).collect()}
    rows = trailing.with_trailing_counts(df).collect()
    by_hour = {}
    for r in rows:
        by_hour[r.Time] = by_hour.get(r.Time, 0) + r.Pickup_Count
        assert (r.Pickup_Count_Dis_4h or 0) >= (r.Pickup_Count_Dis_1h or 0)
    assert by_hour == city
    halo = trailing.neighbour_counts(df).groupBy("Time").sum("Pickup_Count_Nb").collect()
    assert {r[0]: r[1] for r in halo} == {t: 8 * n for t, n in city.items()}


def test_gaps_drop_or_zero(spark):
    cells = {(0, 1, 1): (1, 1), (1, 1, 1): (2, 2), (1, 1, 2): (3, 3), (2, 1, 1): (4, 4), (2, 1, 2): (5, 5)}
    df = facts(spark, cells)
    assert tuples(district_features(df), "Pickup_Count") == [(4,), (5,)]
    zero = district_features(df, gaps="zero")
    assert zero.count() == len(cells)
    assert tuples(zero.filter("Pickup_Count = 1"), "Pickup_Count_Dis_4h", "Pickup_Count_Nb_1h") == [(0, 0)]
    assert tuples(feature_table(df, gaps="zero").filter("Pickup_Count = 1"), "Pickup_Count_Nyc_1h") == [(0,)]
    with pytest.raises(ValueError):
        district_features(df, gaps="other")


def test_one_shuffle_for_own_and_neighbour_counts(spark, tmp_path):
    facts(spark, random_cells(7, 50, (4070, 4073), (-7402, -7399), 30)).write.parquet(str(tmp_path / "f"))
    df = trailing.with_trailing_counts(spark.read.parquet(str(tmp_path / "f")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan

"""The registered queries restated as plain SQL over the test tables, for DuckDB.

Written for clarity, not speed: outer joins, self joins and brute-force pairs where the
Spark plans use one aggregate, a window or a grid.
"""

from __future__ import annotations


MEASURES = ["AWND", "PRCP", "TMAX", "TMIN"]
STATION_NAMES = [f"S{i:02d}" for i in range(11)]
OFFSETS = [0, -3, -2, -1, 1, 2, 3]
COUNTS = ["Pickup_Count", "Dropoff_Count"]

TRIPS = """trips as (
  select event_id, ts as pickup_time,
         ts + to_minutes(cast(floor(value) as bigint)) as dropoff_time,
         cast(user_id % 7 as int) as passenger_count,
         cast(cast(floor(value) as bigint) * 3 - 2 as double) as trip_distance,
         -74000 + (user_id // 3) % 3 * 10 + event_id % 3 as start_lon,
         case when event_id % 17 = 0 then 0 else 40700 + user_id % 3 * 10 + event_id % 5 end as start_lat,
         -74000 + (event_id // 3) % 3 * 10 + user_id % 4 as end_lon,
         case when event_id % 19 = 0 then 0 else 40700 + event_id % 3 * 10 + user_id % 5 end as end_lat
  from events)"""

#: All thousandths derived above round down to their hundredth, so // 10 is the district.
FACTS = TRIPS + """, pickups as (
  select date_trunc('hour', pickup_time) as t, cast(floor(start_lat / 10) as int) as la,
         cast(floor(start_lon / 10) as int) as lo, count(*) as p
  from trips where start_lat between 40000 and 50000 and start_lon between -80000 and -70000 group by 1, 2, 3),
dropoffs as (
  select date_trunc('hour', dropoff_time) as t, cast(floor(end_lat / 10) as int) as la,
         cast(floor(end_lon / 10) as int) as lo, count(*) as d
  from trips where end_lat between 40000 and 50000 and end_lon between -80000 and -70000 group by 1, 2, 3),
facts as (
  select t, la, lo, cast(coalesce(p, 0) as bigint) as p, cast(coalesce(d, 0) as bigint) as d
  from pickups full outer join dropoffs using (t, la, lo))"""

KEY = "t as \"Time\", cast(la as double) / 100 as \"Lat\", cast(lo as double) / 100 as \"Lon\""


def _window_join(name: str, h: int, on: str, label: str) -> str:
    when = ("o.t = f.t - interval 1 hour" if h == 1
            else f"o.t between f.t - interval {h} hour and f.t - interval 1 hour")
    return f""", {name}_{h} as (
  select f.t, f.la, f.lo, cast(sum(o.p) as bigint) as "Pickup_Count_{label}_{h}h",
         cast(sum(o.d) as bigint) as "Dropoff_Count_{label}_{h}h"
  from facts f join facts o on {on} and {when}
  group by 1, 2, 3)"""


SAME = "o.la = f.la and o.lo = f.lo"
AROUND = "abs(o.la - f.la) <= 1 and abs(o.lo - f.lo) <= 1 and (o.la <> f.la or o.lo <> f.lo)"
TRAILING = FACTS + "".join(
    _window_join("dis", h, SAME, "Dis") + _window_join("nb", h, AROUND, "Nb") for h in (1, 4))
CITY = """, city as (select t, sum(p) as p, sum(d) as d from facts group by 1),
city_trailing as (
  select s.t, cast(sum(case when s.i <= 1 then s.p end) as bigint) as "Pickup_Count_Nyc_1h",
         cast(sum(case when s.i <= 1 then s.d end) as bigint) as "Dropoff_Count_Nyc_1h",
         cast(sum(s.p) as bigint) as "Pickup_Count_Nyc_4h", cast(sum(s.d) as bigint) as "Dropoff_Count_Nyc_4h"
  from (select c.t + to_hours(i) as t, i, p, d from city c, (select unnest([1, 2, 3, 4]) as i)) s group by 1)"""

SCORED = FACTS + _window_join("dis", 1, SAME, "Dis") + """, scored as (
  select f.t, f.la, f.lo, cast(s."Pickup_Count_Dis_1h" as double) as prediction, cast(f.p as double) as label
  from facts f join dis_1 s using (t, la, lo)),
errors as (
  select *, abs(label - prediction) as ae, abs(label - prediction) / greatest(label, 1) as pe,
         cast(dayofyear(t) as int) as day, cast(week(t) as int) as week,
         cast(year(t) as int) as day_year, cast(isoyear(t) as int) as week_year
  from scored)"""

_LABELLED = """, {0}_stats as (
  select la, lo, {0}_year as year, {0}, avg(ae * ae) as mse, sqrt(avg(ae * ae)) as rmse, avg(pe * pe) as mspe,
         sqrt(avg(pe * pe)) as rmspe, avg(pe) as mpe from errors group by 1, 2, 3, 4)"""
DAILY, WEEKLY = _LABELLED.format("day"), _LABELLED.format("week")
LATLON = "cast(la as double) / 100 as \"Lat\", cast(lo as double) / 100 as \"Lon\""
STATS = "round(mse, 6) as mse, round(rmse, 6) as rmse, round(mspe, 6) as mspe, round(rmspe, 6) as rmspe, round(mpe, 6) as mpe"


def _extremes(period: str, where: str = "true") -> str:
    picked = ", ".join(
        f"max(case when {kind} = 1 then {column} end) as {name}" for kind in ("best", "worst")
        for column, name in (("year", f"{kind}_year"), (period, f"{kind}_{period}")))
    return f""", extremes as (
  select la, lo, {picked}
  from (select *, row_number() over (partition by la, lo order by mpe, year, {period}) as best,
               row_number() over (partition by la, lo order by mpe desc, year, {period}) as worst
        from {period}_stats where {where}) group by 1, 2)"""


def _extreme_rows(period: str, where: str = "true") -> str:
    stats = {"day": DAILY, "week": WEEKLY}[period]
    return f"""with {SCORED}{stats}{_extremes(period, where)} select {KEY}, kind, x.year, x.{period}, prediction, label
      from errors e join (select la, lo, 'best' as kind, best_year as year, best_{period} as {period} from extremes union all
                          select la, lo, 'worst', worst_year, worst_{period} from extremes) x
      using (la, lo) where e.{period} = x.{period} and e.{period}_year = x.year"""


def observations(folded: bool) -> str:
    day = ("date '2024-01-01' + cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) % 30 as int)"
           if folded else "cast(l_shipdate as date)")
    return f"""raw as (
  select {day} as d, cast(l_suppkey % 11 as int) as st, l_quantity, l_partkey, l_orderkey, l_linenumber from lineitem),
obs as (
  select d, st, 'S' || lpad(cast(st as varchar), 2, '0') as station,
         cast(st * 7 % 11 as double) as lat, cast(st * 3 % 11 as double) as lon,
         case when day(d) <> 7 then cast(l_partkey % 40 - l_orderkey % 10 as double) end as "TMIN",
         case when (day(d) * 3 + st) % 4 <> 0 then cast(l_partkey % 40 as double) end as "TMAX",
         case when (day(d) * 7 + st) % 5 <> 0 then cast(l_quantity as double) end as "PRCP",
         case when (day(d) + st) % 2 <> 0 and st <> 3 then cast(l_linenumber as double) end as "AWND"
  from raw)"""


def _imputed() -> str:
    """Long form: own value, else mean of the three nearest with one, else the overall mean."""
    parts = [observations(True), """coords as (select station, avg(lat) as lat, avg(lon) as lon from obs group by 1),
days as (select distinct d from obs),
near as (select a.station, b.station as other, row_number() over (partition by a.station
         order by (a.lat - b.lat) ^ 2 + (a.lon - b.lon) ^ 2, b.station) as r
         from coords a join coords b on a.station <> b.station),
sd as (select d, station, sum("TMIN") as "TMIN", sum("TMAX") as "TMAX", sum("PRCP") as "PRCP", sum("AWND") as "AWND"
       from obs group by 1, 2),
grid as (select d, station from days, coords)"""]
    for m in MEASURES:
        parts.append(f"""n_{m} as (
  select d, station, sum(v) / count(*) as v from (
    select g.d, g.station, s."{m}" as v, row_number() over (partition by g.d, g.station order by n.r) as k
    from grid g join near n on n.station = g.station join sd s on s.d = g.d and s.station = n.other
    where s."{m}" is not null) where k <= 3 group by 1, 2)""")
    cols = ", ".join(f'coalesce(s."{m}", n_{m}.v, (select avg("{m}") from obs)) as "{m}"' for m in MEASURES)
    joins = " ".join(f"left join n_{m} on n_{m}.d = g.d and n_{m}.station = g.station" for m in MEASURES)
    parts.append(f"""imputed as (select g.d, g.station, {cols} from grid g
      left join sd s on s.d = g.d and s.station = g.station {joins})""")
    return ",\n".join(parts)


def _wide(source: str) -> str:
    cols = ", ".join(f"""sum(case when station = '{s}' then "{m}" end) as "{m}_{s}" """
                     for m in MEASURES for s in STATION_NAMES)
    return f'select d as "Date", {cols} from {source} group by 1'


CITY_EVENTS = """ev as (
  select o_orderkey as id, 'g' || o_orderkey as guid,
         timestamp '2024-01-01 00:17:00' + to_hours(cast(
           (date_diff('day', date '1995-01-01', cast(o_orderdate as date)) % 30) * 24 + o_orderkey % 24 as bigint)) as s,
         o_custkey % 4 as extra, case when o_custkey % 7 = 0 then 0 else o_orderkey % 10 end as score,
         case when o_custkey % 7 = 0 then -1.0 else o_orderkey % 10 end as raw_score,
         case when o_orderkey % 101 <> 0 then 40700 + (o_custkey % 20) % 5 * 10 end as la,
         case when o_orderkey % 101 <> 0 then -74000 + (o_custkey % 20) // 5 * 10 end as lo
  from orders)"""
VENUES = CITY_EVENTS + """, venues as (
  select la, lo, cast(row_number() over (order by la, lo) - 1 as int) as venue_id
  from (select distinct la, lo from ev where la is not null)),
vh as (
  select t, venue_id, count(*) as n from (
    select venue_id, unnest(generate_series(date_trunc('hour', s), date_trunc('hour', s) + to_hours(extra), interval 1 hour)) as t
    from ev join venues using (la, lo))
  where t between timestamp '2024-01-01 00:00:00' and timestamp '2024-01-30 23:00:00' group by 1, 2),
cal as (select unnest(generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-01-30 23:00:00', interval 1 hour)) as t)"""


def _entries(source: str) -> str:
    return f"string_agg(venue_id || ':' || n, ',' order by venue_id) from {source}"


def _offset_lists() -> str:
    """Per hour and offset i the venues active at t - i, as text."""
    ctes = "".join(f""", o{k} as (select t + to_hours({i}) as t, {_entries('vh')} group by 1)"""
                   .replace("from vh group", "as v from vh group") for k, i in enumerate(OFFSETS))
    cols = ", ".join(f"coalesce(o{k}.v, '') as \"Venues_{i}h\"" for k, i in enumerate(OFFSETS))
    joins = " ".join(f"left join o{k} on o{k}.t = cal.t" for k in range(len(OFFSETS)))
    return ctes + f""", venue_lists as (select cal.t, {cols} from cal {joins}
      where cal.t between timestamp '2024-01-01 03:00:00' and timestamp '2024-01-30 20:00:00')"""


HOLIDAY = """(cast({0} as date) in (date '2024-01-01', date '2024-01-15'))"""
PARTS = f"""cast(hour(t) as int) as "Hour", cast(isodow(t) - 1 as int) as "Day_Of_Week",
  cast(dayofyear(t) as int) as "Day_Of_Year", {HOLIDAY.format('t')} as "Is_Holiday" """


def _heat(source: str, frame: str, where: str, value: str, name: str, la: str, lo: str, offset: str) -> str:
    cast = "bigint" if name == "pickups" else "double"
    return f"""with {source}, g as (
  select cast({frame} as int) as frame, {la} as la, {lo} as lo, cast({value} as {cast}) as v from {where} group by 1, 2, 3)
select frame, cast(la as double) / 1000 as lat, cast(lo as double) / 1000 as lon, v as {name},
       round(v / (select max(v) from g) + {offset}, 6) as weight from g"""


def _pickup_heat(frame: str, extra: str = "") -> str:
    box = f"trips where start_lat between 40000 and 50000 and start_lon between -80000 and -70000 {extra}"
    return _heat(TRIPS, frame, box, "count(*)", "pickups", "start_lat", "start_lon", "0")


def _event_heat(frame: str) -> str:
    return _heat(CITY_EVENTS, frame, "ev where la is not null", "sum(score)", "score", "la", "lo", "1")


WEATHER = [f"{m}_{s}" for m in MEASURES for s in STATION_NAMES]
TRAILING_COLUMNS = [f"{c}_{g}_{h}h" for g in ("Dis", "Nb", "Nyc") for h in (1, 4) for c in COUNTS]
FEATURES = f"{TRAILING}{CITY}, {_imputed()}, wide as ({_wide('imputed')}), {VENUES}{_offset_lists()}"


def _profile(base: str, rows: str, scaled: bool) -> str:
    """Rows and sum of every vector entry that is not 0, over the rows of one side of the split."""
    numbers = TRAILING_COLUMNS + WEATHER
    if scaled:
        parts = [f"""select 'scaled_{i}' as feature, "{c}" / nullif((select stddev_samp("{c}") from base
                     where t < timestamp '2024-01-24'), 0) as value from part""" for i, c in enumerate(numbers)]
        parts += [f"""select '{c}', cast("{c}" as double) - {off} from part"""
                  for c, off in (("Hour", 0), ("Day_Of_Week", 0), ("Day_Of_Year", 1))]
    else:
        parts = [f"""select '{c}' as feature, cast("{c}" as double) as value from part""" for c in numbers]
        parts += [f"""select '{c}_vector_' || ("{c}" - {off}), 1 from part"""
                  for c, off in (("Hour", 0), ("Day_Of_Week", 0), ("Day_Of_Year", 1))]
    parts.append("""select 'Is_Holiday', cast("Is_Holiday" as double) from part""")
    parts += [f"""select 'Venues_{i}h_' || venue_id, cast(n as double) from part join vh on vh.t = part.t - to_hours({i})"""
              for i in OFFSETS]
    return (f"with {base}, part as (select * from base where {rows}) select feature, count(*) as rows, "
            f"round(sum(value), 3) as total from ({' union all '.join(parts)}) where value <> 0 group by 1")


ENRICH = """crawl as (
  select c_custkey as k, n_name as address,
         case when c_custkey % 5 = 0 or c_custkey % 7 = 0 then null else 40700000 + (c_custkey // 2) * 6151 % 3000 * 10 end as la0,
         case when c_custkey % 5 = 0 or c_custkey % 7 = 0 then null else -74000000 + (c_custkey // 2) * 3571 % 3000 * 10 end as lo0
  from customer join nation on c_nationkey = n_nationkey),
geo as (select n_name as address, 40700000 + n_nationkey::bigint * 7919 % 3000 * 10 as la,
               -74000000 + n_nationkey::bigint * 4523 % 3000 * 10 as lo from nation where n_regionkey <> 2),
placed as (
  select k, address, cast(coalesce(la0, la) as double) / 1000000 as lat, cast(coalesce(lo0, lo) as double) / 1000000 as lng
  from crawl left join geo using (address)),
ven as (select 'V' || lpad(cast(s_suppkey as varchar), 9, '0') as id, cast(s_suppkey % 10 as double) as score,
               cast(40700000 + s_suppkey * 7919 % 3000 * 10 as double) / 1000000 as lat,
               cast(-74000000 + s_suppkey * 4523 % 3000 * 10 as double) / 1000000 as lon
        from supplier where s_suppkey % 29 <> 0),
spots as (select distinct lat, lng from placed where lat is not null),
ranked as (
  select p.lat, p.lng, v.id, v.score, v.lat as vla, v.lon as vlo, row_number() over (partition by p.lat, p.lng
         order by pow(v.lat - p.lat, 2) + pow(v.lon - p.lng, 2), v.id) as r
  from spots p, ven v),
nearest as (
  select * from (
    select lat, lng, id, score,
      sqrt(pow(radians(vla - lat) * 6378137.0 * (1 - e2) / pow(1 - e2 * pow(sin(mid), 2), 1.5), 2)
         + pow(radians(vlo - lng) * 6378137.0 / sqrt(1 - e2 * pow(sin(mid), 2)) * cos(mid), 2)) as metres
    from (select *, radians((lat + vla) / 2) as mid, 0.0066943799901413165 as e2 from ranked where r = 1))
  where metres < 50)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    dis_cols = ", ".join(f'"{c}_{{0}}_{h}h"' for h in (1, 4) for c in COUNTS)

    sql["district_hour_counts"] = f'with {FACTS} select {KEY}, p as "Pickup_Count", d as "Dropoff_Count" from facts'
    sql["trailing_district"] = (
        f'with {TRAILING} select {KEY}, p as "Pickup_Count", d as "Dropoff_Count", {dis_cols.format("Dis")} '
        "from facts join dis_1 using (t, la, lo) join dis_4 using (t, la, lo)")
    sql["trailing_neighbors"] = (
        f'with {TRAILING} select {KEY}, p as "Pickup_Count", d as "Dropoff_Count", {dis_cols.format("Nb")} '
        "from facts join nb_1 using (t, la, lo) join nb_4 using (t, la, lo)")
    sql["trailing_city"] = f'with {FACTS}{CITY} select t as "Time", * exclude (t) from city_trailing'
    sql["neighbor_counts"] = (
        f"with {FACTS}, shifted as (select t, la + dy as la, lo + dx as lo, p, d from facts, "
        "(select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx) where dy <> 0 or dx <> 0) "
        f'select {KEY}, cast(sum(p) as bigint) as "Pickup_Count_Nb", cast(sum(d) as bigint) as "Dropoff_Count_Nb" '
        "from shifted group by t, la, lo")
    sql["city_hours"] = (
        f'with {FACTS} select t as "Time", cast(sum(p) as bigint) as "Pickup_Count_Nyc", '
        'cast(sum(d) as bigint) as "Dropoff_Count_Nyc" from facts group by 1')
    sql["calendar_features"] = f'with {FACTS} select t as "Time", {PARTS} from (select distinct t from facts)'
    sql["zero_filled_features"] = (
        f"with {TRAILING}{CITY} select {KEY}, p as \"Pickup_Count\", "
        + ", ".join(f'coalesce("{c}_{g}_{h}h", 0) as "{c}_{g}_{h}h"'
                    for g in ("Dis", "Nb", "Nyc") for h in (1, 4) for c in COUNTS)
        + f", {PARTS} from facts left join dis_1 using (t, la, lo) left join dis_4 using (t, la, lo) "
          "left join nb_1 using (t, la, lo) left join nb_4 using (t, la, lo) left join city_trailing using (t) "
          "where t between timestamp '2024-01-01' and timestamp '2024-01-30 23:00:00'")

    weather_cols = ", ".join(f'round("{c}", 6) as "{c}"' for c in WEATHER)
    venue_cols = ", ".join(f'"Venues_{i}h"' for i in OFFSETS)
    counts = ", ".join(f'"{c}"' for c in TRAILING_COLUMNS)
    base = FEATURES + f""", base as (
      select t, la, lo, p, {counts}, {PARTS}, wide.*, {venue_cols}
      from facts join dis_1 using (t, la, lo) join dis_4 using (t, la, lo) join nb_1 using (t, la, lo)
      join nb_4 using (t, la, lo) join city_trailing using (t)
      join wide on wide."Date" = cast(t as date) join venue_lists using (t))"""
    sql["feature_table"] = (
        f'with {base} select {KEY}, p as "Pickup_Count", {counts}, '
        f'"Hour", "Day_Of_Week", "Day_Of_Year", "Is_Holiday", {weather_cols}, {venue_cols} from base')
    sql["onehot_features"] = _profile(base, "t < timestamp '2024-01-24'", scaled=False)
    sql["scaled_features"] = _profile(base, "t >= timestamp '2024-01-24'", scaled=True)

    sql["weather_pivot"] = f"with {observations(True)} {_wide('obs')}"
    sql["weather_imputed"] = f"""with {_imputed()} select d as "Date", station as "Station",
      {", ".join(f'round("{m}", 6) as "{m}"' for m in MEASURES)} from imputed"""
    sql["weather_imputed_long"] = sql["weather_imputed"]
    sql["weather_by_number"] = f"""with {_imputed()} select d as "Date", station as "Station",
      cast(dense_rank() over (order by station) - 1 as int) as station_id,
      {", ".join(f'round("{m}", 6) as "{m}"' for m in MEASURES)} from imputed"""
    sql["measure_means"] = f"with {observations(True)} select " + ", ".join(
        f'round(avg("{m}"), 6) as "{m}"' for m in MEASURES) + " from obs"
    sql["station_coordinates"] = (
        f'with {observations(True)} select station as "Station", avg(lat) as "Lat", avg(lon) as "Lon" from obs group by 1')
    sql["station_neighbors"] = f"""with {_imputed()} select station as "Station", other as "Neighbour",
      cast(r as int) as "Rank" from near where r <= 10"""

    sql["venue_ids"] = (f"with {VENUES} select venue_id, cast(la as double) / 1000 as latitude, "
                        "cast(lo as double) / 1000 as longitude from venues")
    sql["event_hours"] = f'with {VENUES} select t as "Time", venue_id, n from vh'
    sql["event_grid_dense"] = (f"with {VENUES}, per as (select t, {_entries('vh')} group by 1)".replace(
        "from vh group", "as v from vh group") +
        ' select cal.t as "Time", coalesce(per.v, \'\') as "Venues" from cal left join per on per.t = cal.t')
    sql["event_offsets"] = f'with {VENUES}{_offset_lists()} select t as "Time", {venue_cols} from venue_lists'
    sums = ", ".join(f'cast(sum(case when i = {i} then n else 0 end) as bigint) as "Venues_{i}h"' for i in OFFSETS)
    sql["event_offsets_long"] = (
        f'with {VENUES} select t + to_hours(i) as "Time", venue_id, {sums} from vh, '
        "(select unnest([-3, -2, -1, 0, 1, 2, 3]) as i) group by 1, 2")

    sql["heatmap_total"] = _pickup_heat("0")
    sql["heatmap_by_weekday"] = _pickup_heat("isodow(pickup_time) - 1")
    sql["heatmap_by_hour"] = _pickup_heat("hour(pickup_time)")
    fridays = ", ".join(f"date '2024-01-{d:02d}'" for d in (5, 12, 19, 26))
    sql["heatmap_four_days"] = _pickup_heat(
        "(dayofyear(pickup_time) - 5) // 7",
        f"and cast(pickup_time as date) in ({fridays}) and hour(pickup_time) = 19")
    sql["heatmap_weekday_slice"] = _pickup_heat(
        "dayofyear(pickup_time)", "and isodow(pickup_time) = 5 and hour(pickup_time) = 19")
    sql["event_heatmap"] = _event_heat("0")
    sql["event_heatmap_by_weekday"] = _event_heat("isodow(s) - 1")
    sql["event_heatmap_by_hour"] = _event_heat("hour(s)")
    sql["heatmap_documents"] = _pickup_heat("hour(pickup_time)").replace(
        "select frame, cast(la", "select lpad(cast(h as varchar), 2, '0') as name, lpad(cast(h as varchar), 2, '0') || ':00' as title, "
        "10 as point_radius, cast(la").replace(", v as pickups", "").replace(
        "as weight from g", "as weight from (select unnest(range(24)) as h) left join g on g.frame = h")

    weekdays = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
    sql["event_documents"] = _event_heat("isodow(s) - 1").replace(
        "select frame, cast(la", f"select cast(h as varchar) as name, {weekdays}[h + 1] as title, 10 as point_radius, cast(la").replace(
        ", v as score", "").replace("as weight from g", "as weight from (select unnest(range(7)) as h) left join g on g.frame = h")

    sql["trip_histograms"] = f"""with {TRIPS} select part, value, count(*) as n from (
      select 'year' as part, cast(year(pickup_time) as int) as value from trips union all
      select 'month', cast(month(pickup_time) as int) from trips union all
      select 'weekday', cast(isodow(pickup_time) - 1 as int) from trips union all
      select 'hour', cast(hour(pickup_time) as int) from trips) group by 1, 2"""
    sql["value_counts"] = f'with {TRIPS} select passenger_count as "Passenger_Count", count(*) as n from trips group by 1'
    sql["distance_outliers"] = (f'with {TRIPS} select trip_distance as "Trip_Distance", count(*) as n from trips '
                                "where trip_distance <= 0 or trip_distance >= 100 group by 1")
    sql["outlier_audit"] = f"""with {TRIPS} select count(*) as trips,
      count(*) filter (trip_distance <= 0 or trip_distance >= 100) as odd_distance,
      count(*) filter (start_lon <= -80000 or start_lon >= -70000) as start_lon_outside,
      count(*) filter (start_lat <= 40000 or start_lat >= 50000) as start_lat_outside,
      count(*) filter (end_lon <= -80000 or end_lon >= -70000) as end_lon_outside,
      count(*) filter (end_lat <= 40000 or end_lat >= 50000) as end_lat_outside from trips"""
    sql["events_per_month"] = (f"with {CITY_EVENTS} select cast(year(s) as int) as year, cast(month(s) as int) as month, "
                               "count(guid) as n from ev group by 1, 2")
    sql["avg_events_per_day"] = (f"with {CITY_EVENTS} select round(avg(n), 6) as events_per_day from "
                                 "(select cast(s as date), count(guid) as n from ev group by 1)")
    sql["date_slice"] = ("select o_orderkey, o_orderdate from orders where cast(o_orderdate as date) "
                         "between date '1996-02-01' and date '1996-02-29'")
    sql["preview"] = f'with {TRIPS} select event_id, pickup_time as "Pickup_Time" from trips order by 2, 1 limit 5'

    past = observations(False)
    sql["station_coverage_daily"] = f'with {past} select d as "Date", count(station) as station_count from obs group by 1'
    sql["station_coverage_monthly"] = (
        f"with {past} select last_day(d) as month_end, round(avg(n), 6) as mean_station_count from "
        "(select d, count(station) as n from obs group by 1) group by 1")
    sql["station_month_fraction"] = f"""with {past}, days as (select distinct d from obs),
      st as (select distinct station from obs), sd as (select distinct d, station from obs)
      select cast(year(days.d) as int) as year, cast(month(days.d) as int) as month, st.station as "Station",
             round(avg(case when sd.d is null then 0.0 else 1.0 end), 6) as coverage
      from days join st on true left join sd on sd.d = days.d and sd.station = st.station group by 1, 2, 3"""
    sql["daily_std"] = f'with {past} select d as "Date", ' + ", ".join(
        f'round(stddev_pop("{m}"), 6) as "{m}"' for m in MEASURES) + " from obs group by 1"
    sql["describe_measures"] = _describe(past, "obs", MEASURES)
    sql["describe_station_counts"] = _describe(
        f"{past}, per_day as (select d, count(station) as station_count from obs group by 1)", "per_day", ["station_count"])
    spread = ", ".join(f'round(stddev_pop("{m}"), 6) as "{m}"' for m in MEASURES)
    sql["describe_daily_std"] = _describe(f"{past}, spread as (select d, {spread} from obs group by 1)", "spread", MEASURES)
    daily = {
        "PRCP": ("l_linenumber = 7", "l_quantity"), "SNWD": ("l_partkey % 5 = 0", "l_extendedprice"),
        "SNOW": ("l_partkey % 3 = 0", "l_extendedprice * l_tax"), "PSUN": ("l_orderkey % 4 = 0", "l_orderkey % 101"),
        "TSUN": ("l_orderkey % 6 = 0", "l_orderkey % 1441"), "TMAX": ("l_partkey % 8 = 0", "l_partkey % 40"),
        "TMIN": ("l_partkey % 9 = 0", "l_partkey % 40 - l_orderkey % 10"), "TOBS": ("l_linenumber = 3", "l_partkey % 40 - l_linenumber"),
        "AWND": ("l_linenumber = 1", "l_discount")}
    sql["describe_daily_measures"] = _describe("obs as (select " + ", ".join(
        f'case when not ({missing}) then cast({value} as double) end as "{m}"' for m, (missing, value) in daily.items())
        + " from lineitem)", "obs", list(daily))
    sql["describe_hourly_precipitation"] = _describe(
        'obs as (select case when o_orderkey % 5 <> 0 then cast(o_totalprice * (o_orderkey % 3) as double) end as "HPCP" from orders)',
        "obs", ["HPCP"])
    series = "series as (select o_orderdate + to_hours(cast(o_orderkey % 24 as bigint)) as t from orders)"
    sql["hourly_coverage"] = f"""with {series},
      cal as (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-31 23:00:00', interval 1 hour)) as t)
      select cast(year(cal.t) as int) as year, cast(month(cal.t) as int) as month,
             round(avg(case when x.t is null then 0.0 else 1.0 end), 6) as coverage
      from cal left join (select distinct t from series) x on x.t = cal.t group by 1, 2"""
    sql["measurements_per_hour"] = f"with {series} select cast(hour(t) as int) as hour, count(*) as n from series group by 1"

    sql["hourly_errors"] = f"""with {SCORED} select {KEY}, prediction, label, ae as absolute_error,
      ae * ae as squared_error, round(pe, 6) as proportional_error, round(pe * pe, 6) as squared_proportional_error from errors"""
    sql["error_metrics"] = f"""with {SCORED}, s as (select la, lo, avg(ae * ae) as mse, sqrt(avg(ae * ae)) as rmse,
      avg(pe * pe) as mspe, sqrt(avg(pe * pe)) as rmspe, avg(pe) as mpe from errors group by 1, 2) select {LATLON}, {STATS} from s"""
    sql["error_spread"] = f"""with {SCORED}, s as (select la, lo, sqrt(avg(ae * ae)) as rmse, avg(pe) as mpe from errors group by 1, 2)
      select count(*) as districts, round(avg(rmse), 6) as rmse_mean, round(stddev_samp(rmse), 6) as rmse_std,
             round(avg(mpe), 6) as mpe_mean, round(stddev_samp(mpe), 6) as mpe_std from s"""
    sql["daily_errors"] = f"with {SCORED}{DAILY} select {LATLON}, year, day, {STATS} from day_stats"
    sql["weekly_errors"] = f"with {SCORED}{WEEKLY} select {LATLON}, year, week, {STATS} from week_stats"
    sql["error_columns"] = (f"with {SCORED}{DAILY} select {LATLON}, year, day, round(mpe * 2000, 6) as mpe_scaled, "
                            "round(rmspe * 2000, 6) as rmspe_scaled, round(rmse, 6) as rmse from day_stats")
    sql["best_worst_days"] = (f"with {SCORED}{DAILY}{_extremes('day')} "
                              f"select {LATLON}, best_year, best_day, worst_year, worst_day from extremes")
    sql["best_worst_weeks"] = (f"with {SCORED}{WEEKLY}{_extremes('week', 'week not in (1, 53)')} "
                               f"select {LATLON}, best_year, best_week, worst_year, worst_week from extremes")
    sql["best_worst_day_rows"] = _extreme_rows("day")
    sql["best_worst_week_rows"] = _extreme_rows("week", "week not in (1, 53)")
    sql["daily_mean_label"] = f"with {SCORED} select {LATLON}, day_year as year, day, round(avg(label), 6) as mean_label from errors group by la, lo, 3, day"

    sql["top_districts"] = (f'with {FACTS} select {LATLON}, cast(sum(p) as bigint) as "Pickups" from facts '
                            "group by la, lo order by 3 desc, 1, 2 limit 5")
    sql["district_rows"] = f"with {FACTS} select {LATLON}, count(*) as rows from facts group by la, lo"
    sql["listed_districts"] = f"""with {FACTS}, top as (select la, lo from facts group by 1, 2
      order by sum(p) desc, la, lo limit 5) select {KEY}, p as "Pickup_Count", d as "Dropoff_Count" from facts join top using (la, lo)"""
    split = "timestamp '2024-01-24 00:00:00'"
    sql["train_split"] = (f"with {FACTS} select {KEY}, p as \"Pickup_Count\", d as \"Dropoff_Count\", "
                          f"case when t < {split} then 'train' else 'test' end as part from facts")
    sql["train_split_strict"] = sql["train_split"] + f" where t <> {split}"

    sql["geocode_fill"] = f"with {ENRICH} select cast(k as varchar) as id, address, round(lat, 6) as lat, round(lng, 6) as lng from placed"
    sql["needs_geocode"] = f"with {ENRICH} select distinct address from crawl where la0 is null"
    sql["nearest_venue"] = f"with {ENRICH} select round(lat, 6) as lat, round(lng, 6) as lng, id as venue_id from nearest"
    sql["flatten_events"] = f"""with {ENRICH} select cast(k as varchar) as id, 'g' || k as guid,
      strftime(timestamp '2024-01-01' + to_days(cast(k % 30 as int)), '%Y-%m-%dT%H:%M:%S') as start_date,
      strftime(timestamp '2024-01-01' + to_days(cast(k % 30 as int)) + to_hours(case when k % 3 <> 0 then 2 else 0 end),
               '%Y-%m-%dT%H:%M:%S') as end_date,
      k % 2 = 0 as all_day, cast(coalesce(n.score, -1) as double) as score, round(p.lat, 6) as latitude, round(p.lng, 6) as longitude
      from placed p left join nearest n on n.lat = p.lat and n.lng = p.lng
      where p.lat is not null and (k % 13 = 0 or k % 11 <> 0)"""
    sql["event_json_roundtrip"] = sql["event_array_scan"] = sql["flatten_events"]
    sql["flat_event_csv"] = f"""with {CITY_EVENTS} select cast(id as varchar) as id, guid, s as start_date,
      s + to_hours(extra) as end_date, extra = 3 as all_day, cast(raw_score as double) as score,
      cast(la as double) / 1000 as latitude, case when lo is not null then cast(lo as double) / 1000 end as longitude from ev"""

    sql["trip_csv_scan"] = f"""with {TRIPS} select date_trunc('second', pickup_time) as "Pickup_Time",
      date_trunc('second', dropoff_time) as "Dropoff_Time", passenger_count as "Passenger_Count", trip_distance as "Trip_Distance",
      case when event_id % 23 <> 0 then cast(start_lon as double) / 1000 end as "Start_Lon", cast(start_lat as double) / 1000 as "Start_Lat",
      cast(end_lon as double) / 1000 as "End_Lon", cast(end_lat as double) / 1000 as "End_Lat" from trips"""
    sql["file_list_scan"] = """with f as (select distinct year(ts) as y, month(ts) as m from events)
      select cast(y as varchar) as folder, 'trips_' || y || '-' || lpad(cast(m as varchar), 2, '0') || '.csv' as name from f"""
    sql["weather_csv_scan"] = f"""with {observations(True)} select d as "Date", lat as "Lat", lon as "Lon", station as "Station",
      "TMIN", "TMAX", "PRCP", "AWND" from obs"""
    sql["hourly_precipitation_scan"] = """select 'S00' as "Station", date_trunc('minute', ts) as "Time",
      case when event_id % 9 <> 0 then cast(user_id % 50 as double) end as "HPCP" from events"""
    sql["facts_by_month"] = sql["district_hour_counts"]
    sql["district_list_scan"] = f"with {FACTS} select distinct {LATLON} from facts"
    sql["prediction_csv"] = f"with {SCORED} select {KEY}, prediction, label from scored"
    sql["error_csv"] = sql["error_metrics"]

    sql["coordinate_guard"] = f"""with {TRIPS} select count(*) as trips,
      count(*) filter (event_id % 23 <> 0) as numeric_lon,
      count(*) filter (event_id % 23 <> 0 and start_lat between 40000 and 50000 and start_lon between -80000 and -70000) as usable
      from trips"""
    sql["scalar_functions"] = f"""select event_id, date_trunc('hour', ts) as hour_start, date_trunc('hour', ts) + interval 3 hour as plus_3h,
      cast(hour(ts) as int) as hour, cast(dayofyear(ts) as int) as day_of_year, cast(isodow(ts) - 1 as int) as weekday,
      cast(year(ts) as int) as year, cast(month(ts) as int) as month, cast(week(ts) as int) as week, cast(ts as date) as day,
      cast(ts as date) as compact_day, date_trunc('minute', ts) as compact_minute, date_trunc('second', ts) as iso_second,
      {HOLIDAY.format('ts')} as holiday, lpad(cast(hour(ts) as varchar), 2, '0') || ':00' as hour_label,
      dayname(ts) as weekday_name, round(value, 2) as value_2, round(sqrt(abs(value)), 6) as root,
      round(pow(2.0, -(user_id % 5)), 6) as node_value, greatest(user_id, 1) as at_least_one,
      case when event_id % 4 <> 0 then value end as number from events"""
    sql["sample_districts"] = (
        f"with {FACTS}, top as (select la, lo from facts group by 1, 2 order by sum(p) desc, la, lo limit 8) "
        f"select {LATLON} from top order by md5(la || '|' || lo || '|1234') limit 4")
    sql["sample_by_key"] = _sample("0.1", "events")
    sql["bernoulli_sample"] = """select event_id, ts from (select *, row_number() over () - 1 as place from events)
      where cast(('0x' || substr(md5('events.parquet|' || place || '|1234'), 1, 8)) as bigint) / 4294967296.0 < 0.1"""
    sql["yearly_samples"] = f"""with {TRIPS}, lines as (
        select *, 2013 + event_id % 2 as year, concat_ws(',', event_id, strftime(pickup_time, '%Y-%m-%d %H:%M:%S'),
          strftime(dropoff_time, '%Y-%m-%d %H:%M:%S'), passenger_count, cast(trip_distance as int), 0, 0, 'N', 1, 0, 0) as line
        from trips)
      select date_trunc('second', pickup_time) as "Pickup_Time", date_trunc('second', dropoff_time) as "Dropoff_Time",
        passenger_count as "Passenger_Count", trip_distance as "Trip_Distance" from lines
      where cast(('0x' || substr(md5(year || '|' || line || '|1234'), 1, 8)) as bigint) / 4294967296.0 < 0.1"""
    sql["sample_by_year"] = (
        "select o_orderkey, o_orderdate from orders where cast(('0x' || substr(md5(o_orderkey || '|7'), 1, 8)) as bigint) "
        "/ 4294967296.0 < case when year(o_orderdate) = 1996 then 0.5 else 0.01 end")

    rows = f"({sql['feature_table']})"
    split = "timestamp '2024-01-24'"
    sql["forest_structure"] = (
        'select "Lat", "Lon", cast(5 as bigint) as trees, cast(5 as bigint) as leaves_over_inner, '
        f'cast(5 as double) as root_score from {rows} where "Time" < {split} group by 1, 2')
    sql["linear_orthogonality"] = (
        f'select "Lat", "Lon", count(*) as rows, true as orthogonal from {rows} where "Time" < {split} group by 1, 2')
    sql["forest_scored_rows"] = (
        f'select "Lat", "Lon", count(*) as scored, true as within_labels from {rows} where "Time" >= {split} '
        f'and ("Lat", "Lon") in (select ("Lat", "Lon") from {rows} where "Time" < {split}) group by 1, 2')
    sql["category_arity"] = " union all ".join(
        f"select '{c}' as feature, {arity} as arity, cast(min({v}) as double) as lowest, cast(max({v}) as double) as highest, "
        f'count(distinct {v}) as values from {rows} where "Time" < {split}'
        for c, arity, v in (("Hour", 24, 'hour("Time")'), ("Day_Of_Week", 7, 'isodow("Time") - 1'),
                            ("Day_Of_Year", 366, 'dayofyear("Time") - 1'), ("Is_Holiday", 2, 'cast("Is_Holiday" as int)')))
    sql["holidays"] = HOLIDAYS
    for name, columns in LINEAR_CHECK.items():
        sql[name] = columns
    return sql


def _describe(ctes: str, source: str, measures: list[str]) -> str:
    columns = "round({0}, 6)".format
    return f"with {ctes} " + " union all ".join(
        f"""select '{m}' as measure, count("{m}") as "count", {columns(f'avg("{m}")')} as mean,
            {columns(f'stddev_samp("{m}")')} as std, {columns(f'cast(min("{m}") as double)')} as min,
            {columns(f'quantile_cont(cast("{m}" as double), 0.25)')} as q25,
            {columns(f'quantile_cont(cast("{m}" as double), 0.5)')} as q50,
            {columns(f'quantile_cont(cast("{m}" as double), 0.75)')} as q75,
            {columns(f'cast(max("{m}") as double)')} as max from {source}""" for m in measures)


def _sample(fraction: str, table: str) -> str:
    return (f"select event_id, ts from {table} where cast(('0x' || substr(md5(event_id || '|1234'), 1, 8)) as bigint) "
            f"/ 4294967296.0 < {fraction}")


#: The rules restated: weekday (Monday 1) and range of days, or fixed days with their first year.
HOLIDAYS = """
with days as (select distinct cast(o_orderdate as date) + 9862 as day from orders),
fixed as (select * from (values (1, 1, 1), (6, 19, 2021), (7, 4, 1), (11, 11, 1), (12, 25, 1)) as f(m, n, since)),
floating as (select * from (values (1, 1, 15, 21), (2, 1, 15, 21), (5, 1, 25, 31), (9, 1, 1, 7), (10, 1, 8, 14),
  (11, 4, 22, 28)) as f(m, weekday, lo, hi))
select day from days where
  exists (select 1 from floating where month(day) = m and isodow(day) = weekday and day(day) between lo and hi)
  or exists (select 1 from fixed where year(day) >= since and month(day) = m and day(day) = n)
  or (isodow(day) = 5 and exists (select 1 from fixed where year(day + 1) >= since and month(day + 1) = m and day(day + 1) = n))
  or (isodow(day) = 1 and exists (select 1 from fixed where year(day - 1) >= since and month(day - 1) = m and day(day - 1) = n))
"""

#: Least squares through the origin on two columns, in closed form.
_NORMAL = SCORED.replace("cast(f.p as double) as label", "cast(f.p as double) as label, cast(hour(f.t) as double) as h")


def _linear(rows: str) -> str:
    return f"""with {_NORMAL}, s as (
      select la, lo, count(*) as n, sum(prediction * prediction) as aa, sum(prediction * h) as ab, sum(h * h) as bb,
             sum(prediction * label) as ay, sum(h * label) as bl from scored where {rows} group by 1, 2),
    fitted as (select la, lo, n, (ay * bb - bl * ab) / (aa * bb - ab * ab) as w_trailing,
             (bl * aa - ay * ab) / (aa * bb - ab * ab) as w_hour from s)"""


def _linear_errors(chosen: str) -> str:
    return f"""{_linear("t < timestamp '2024-01-24'")}, e as (
      select la, lo, abs(w_trailing * prediction + w_hour * h - label) as ae, greatest(label, 1) as g
      from scored join fitted using (la, lo) where {chosen}),
    m as (select la, lo, avg(ae * ae) as mse, sqrt(avg(ae * ae)) as rmse, avg(ae / g * (ae / g)) as mspe,
                 sqrt(avg(ae / g * (ae / g))) as rmspe, avg(ae / g) as mpe from e group by 1, 2)
    select {LATLON}, {STATS} from m"""


#: A draw of half the rows by district and hour.
_HALF = ("cast(('0x' || substr(md5(strftime(t, '%Y%m%d%H') || '|' || la || '|' || lo || '|1234'), 1, 8)) as bigint) "
         "/ 4294967296.0 < 0.5")

LINEAR_CHECK = {
    "train_linear": f"""{_linear("true")} select {LATLON}, n as rows, round(w_trailing, 6) as w_trailing,
      round(w_hour, 6) as w_hour from fitted""",
    "predict_linear": _linear_errors("t >= timestamp '2024-01-24'"),
    "training_errors": _linear_errors("t < timestamp '2024-01-24'"),
    "sampled_errors": _linear_errors(f"t >= timestamp '2024-01-24' and {_HALF}"),
}

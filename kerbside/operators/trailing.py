"""Counts of the preceding hours: own district, the eight neighbours, the whole city.

Plan for own and neighbour counts: the fact rows are sent once to (tile, block) groups,
where a tile is a square of districts and a block a stretch of hours. Rows at a tile's
rim also go to the tile next to it, and rows at a block's end to the next block, so that
each group can answer for its own rows alone. Aggregate and window both cluster on a
superset of (tile, block) and hence run without a further exchange. A group holds at most
(tile + 2)^2 districts x (block + longest window) hours, whatever the number of trips,
so one busy district never becomes one long task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.functions import timeparts as tp
from kerbside.operators.facts import COUNTS, FACT_KEY

HOURS = (1, 4)
TILE_CELLS = 16
BLOCK_HOURS = 7 * 24


def _both(low: Column, high: Column) -> Column:
    """The one or two group numbers between ``low`` and ``high``."""
    return F.explode(F.array_distinct(F.array(low, high)))


def _group(ix: Column, size: int) -> Column:
    return F.floor(ix / size).cast("int")


def _grouped(facts: DataFrame, longest: int, tile: int, block: int, halo: int) -> DataFrame:
    """Facts keyed by every (tile, block) that needs them, in one shuffle."""
    lat, lon, hour = F.col("lat_cell"), F.col("lon_cell"), F.col("hour_ix")
    return (
        facts.select(
            geo.cell_of(F.col("Lat")).alias("lat_cell"),
            geo.cell_of(F.col("Lon")).alias("lon_cell"),
            tp.hour_index(F.col("Time")).alias("hour_ix"),
            *COUNTS,
        )
        .withColumn("block", _both(_group(hour, block), _group(hour + longest, block)))
        .withColumn("tile_y", _both(_group(lat - halo, tile), _group(lat + halo, tile)))
        .withColumn("tile_x", _both(_group(lon - halo, tile), _group(lon + halo, tile)))
        .repartition("tile_y", "tile_x", "block")
    )


def with_trailing_counts(
    facts: DataFrame,
    hours: Sequence[int] = HOURS,
    neighbours: bool = True,
    tile: int = TILE_CELLS,
    block: int = BLOCK_HOURS,
) -> DataFrame:
    """Fact rows with ``{count}_Dis_{h}h`` and, on request, ``{count}_Nb_{h}h``.

    Hours T-h .. T-1 are summed, the current hour excluded, over rows that exist; null
    where none exists. Neighbour counts cover the eight surrounding districts, which
    need not have a row of their own at T.
    """
    longest = max(hours)
    if longest > block or tile < 2:
        raise ValueError("a window must fit into one block, a tile must span two districts")
    group = ["tile_y", "tile_x", "block"]
    rows = _grouped(facts, longest, tile, block, 1 if neighbours else 0)

    own = F.col("dy").eqNullSafe(0) & F.col("dx").eqNullSafe(0)
    steps = range(-1, 2) if neighbours else (0,)
    offsets = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in steps for x in steps])
    cells = (
        rows.select("*", F.inline(offsets))
        .withColumns({"lat_cell": F.col("lat_cell") + F.col("dy"), "lon_cell": F.col("lon_cell") + F.col("dx")})
        .filter((_group(F.col("lat_cell"), tile) == F.col("tile_y"))
                & (_group(F.col("lon_cell"), tile) == F.col("tile_x")))
        .groupBy(*group, "lat_cell", "lon_cell", "hour_ix")
        .agg(
            *[F.sum(F.when(own, F.col(c))).alias(f"own_{c}") for c in COUNTS],
            *[F.sum(F.when(~own, F.col(c))).alias(f"nb_{c}") for c in COUNTS if neighbours],
        )
    )
    history = W.partitionBy(*group, "lat_cell", "lon_cell").orderBy("hour_ix")
    kinds = [("own", "Dis")] + ([("nb", "Nb")] if neighbours else [])
    sums = {
        f"{c}_{label}_{h}h": F.sum(f"{source}_{c}").over(history.rangeBetween(-h, -1))
        for source, label in kinds for h in hours for c in COUNTS
    }
    return (
        cells.withColumns(sums)
        # rows that only carry a neighbour's counts, or another block's history, have served
        .filter(F.col("own_Pickup_Count").isNotNull() & (_group(F.col("hour_ix"), block) == F.col("block")))
        .select(
            tp.hour_from_index(F.col("hour_ix")).alias("Time"),
            geo.degrees_of(F.col("lat_cell")).alias("Lat"),
            geo.degrees_of(F.col("lon_cell")).alias("Lon"),
            *[F.col(f"own_{c}").alias(c) for c in COUNTS],
            *sums,
        )
    )


def neighbour_counts(facts: DataFrame) -> DataFrame:
    """Counts of the eight surrounding districts in the same hour, wherever any exist.

    Wide in districts, so it is a plain aggregate; the trailing form above does not
    need it.
    """
    steps = [(y, x) for y in range(-1, 2) for x in range(-1, 2) if (y, x) != (0, 0)]
    offsets = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in steps])
    return (
        facts.select("Time", geo.cell_of(F.col("Lat")).alias("lat_cell"),
                     geo.cell_of(F.col("Lon")).alias("lon_cell"), *COUNTS)
        .select("*", F.inline(offsets))
        .groupBy("Time", (F.col("lat_cell") + F.col("dy")).alias("lat_cell"),
                 (F.col("lon_cell") + F.col("dx")).alias("lon_cell"))
        .agg(*[F.sum(c).alias(f"{c}_Nb") for c in COUNTS])
        .select("Time", geo.degrees_of(F.col("lat_cell")).alias("Lat"),
                geo.degrees_of(F.col("lon_cell")).alias("Lon"), *[f"{c}_Nb" for c in COUNTS])
    )


def city_hours(facts: DataFrame) -> DataFrame:
    """Counts of the whole city per hour."""
    return facts.groupBy("Time").agg(*[F.sum(c).alias(f"{c}_Nyc") for c in COUNTS])


def city_trailing(facts: DataFrame, hours: Sequence[int] = HOURS) -> DataFrame:
    """``{count}_Nyc_{h}h`` for every hour with a preceding hour inside the window.

    Each hourly total is handed to the hours that look back on it; no window over the
    whole series, which would be a single task.
    """
    longest = max(hours)
    shifted = city_hours(facts).withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(longest))))
    return (
        shifted.groupBy((F.col("Time") + F.make_dt_interval(F.lit(0), F.col("shift"))).alias("Time"))
        .agg(*[
            F.sum(F.when(F.col("shift") <= h, F.col(f"{c}_Nyc"))).alias(f"{c}_Nyc_{h}h")
            for h in hours for c in COUNTS
        ])
    )


def trailing_columns(hours: Sequence[int] = HOURS) -> list[str]:
    """The twelve count features in table order."""
    return [f"{c}_{label}_{h}h" for label in ("Dis", "Nb", "Nyc") for h in hours for c in COUNTS]


__all__ = ["FACT_KEY", "HOURS", "city_hours", "city_trailing", "neighbour_counts",
           "trailing_columns", "with_trailing_counts"]

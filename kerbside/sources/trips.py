"""Monthly trip files whose column names drift while their positions do not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.values import number_or_null

# Position in the file -> our name.
TRIP_POSITIONS = {
    1: "Pickup_Time", 2: "Dropoff_Time", 5: "Start_Lon", 6: "Start_Lat", 9: "End_Lon", 10: "End_Lat",
}
SAMPLE_POSITIONS = {
    1: "Pickup_Time", 2: "Dropoff_Time", 3: "Passenger_Count", 4: "Trip_Distance",
    5: "Start_Lon", 6: "Start_Lat", 9: "End_Lon", 10: "End_Lat",
}
_TIMES = {"Pickup_Time", "Dropoff_Time"}
_WHOLE = {"Passenger_Count"}


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``folder, name`` from lines like ``2009/trips_2009-03.csv``."""
    line = F.split(F.trim("value"), "/")
    return (
        spark.read.text(path).filter(F.trim("value") != "")
        .select(line[0].alias("folder"), F.element_at(line, -1).alias("name"))
    )


def listed_paths(spark: SparkSession, base: str, list_path: str) -> list[str]:
    """Paths below ``base`` named by a file list: a driver-side list of file names, no data."""
    rows = listed_files(spark, list_path).orderBy("folder", "name").collect()
    return [f"{base.rstrip('/')}/{r.name}" for r in rows]


def read_trips(spark: SparkSession, paths: str | Sequence[str],
               positions: Mapping[int, str] = TRIP_POSITIONS) -> DataFrame:
    """Trips of all files, columns picked by position whatever their header says.

    The leading columns are declared as text and the header is skipped: nothing is
    inferred, files of any width share one scan, and only the picked columns are parsed.
    Text that is no number, or no time, becomes null.
    """
    fields = ", ".join(f"c{i} string" for i in range(max(positions) + 1))
    raw = (
        spark.read.schema(fields)
        .option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True)
        .csv(paths if isinstance(paths, str) else list(paths))
    )

    def typed(i: int, name: str) -> Column:
        c = F.col(f"c{i}")
        if name in _TIMES:
            return F.try_to_timestamp(c).alias(name)
        value = number_or_null(c)
        return (value.cast("int") if name in _WHOLE else value).alias(name)

    return raw.select(*[typed(i, n) for i, n in positions.items()])


#: Whole lines as one column: a character that no trip file holds stands for the separator.
_WHOLE_LINES = {"header": True, "sep": "\u0001", "quote": "", "escape": ""}


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``year, line``: lines of trip files as they stand, headers left out. The year is the one in
    the path, as in ``trips_2009-03.csv``; a path without one is an error."""
    raw = (
        spark.read.schema("line string").options(**_WHOLE_LINES).option("enforceSchema", True)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    year = F.regexp_extract("_metadata.file_path", r"(\d{4})-\d{2}\.csv", 1)
    checked = F.when(year == "", F.raise_error(F.lit("trip file without a year and month in its path"))).otherwise(year)
    return raw.select(checked.cast("int").alias("year"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in one directory per year, each file with a header line, as trip files have."""
    lines.write.partitionBy("year").options(**_WHOLE_LINES).csv(path)


def merge_samples(spark: SparkSession, path: str) -> DataFrame:
    """Yearly samples as one table of the columns that are used, picked by position."""
    return read_trips(spark, f"{path.rstrip('/')}/year=*", SAMPLE_POSITIONS)

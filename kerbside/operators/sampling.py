"""Bernoulli samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_FRACTION = 0.01
_DIGITS = 8  # hex digits of the hash that are read as a fraction


def _unit(keys: list[str | Column], seed: int) -> Column:
    """A number from 0 to 1 that hangs on the keys and the seed alone."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *[k.cast("string") for k in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / float(16 ** _DIGITS)


def bernoulli(scan: DataFrame, percentage: float, seed: int) -> DataFrame:
    """Each row of Parquet files, as read, is kept with probability ``percentage`` / 100.

    The draw hangs on the file's name and the row's place in it: a repeated task, another
    split of the files or another partitioning draws the same rows. Nothing is shuffled.
    """
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return scan.filter(_unit(place, seed) < percentage / 100.0)


def bernoulli_rows(df: DataFrame, percentage: float, seed: int) -> DataFrame:
    """The same for any table, whose rows have no places: the draw hangs on the row's values
    and on its number among equal rows, which are counted before anything is shuffled."""
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_rows"))
    values = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    numbered = counted.withColumn("_number", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))))
    return numbered.filter(_unit([values, F.col("_number")], seed) < percentage / 100.0).select(*[F.col(f"`{c}`") for c in df.columns])


def bernoulli_by_key(df: DataFrame, keys: list[str | Column], fraction: float | Column, seed: int) -> DataFrame:
    """Like ``bernoulli``, but the draw hangs on the key: the same rows come back whatever
    the partitioning, file layout, or lost and repeated tasks."""
    limit = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return df.filter(_unit(keys, seed) < limit)


def yearly_sample(df: DataFrame, time: str, keys: list[str], seed: int,
                  fraction: float = KEEP_FRACTION, by_year: dict[int, float] | None = None) -> DataFrame:
    """A sample per year, each with its own fraction where one is given."""
    limit = F.lit(float(fraction))
    for year, share in (by_year or {}).items():
        limit = F.when(F.year(time) == year, F.lit(float(share))).otherwise(limit)
    return bernoulli_by_key(df, keys, limit, seed)


def yearly_lines(lines: DataFrame, seed: int, fraction: float = KEEP_FRACTION) -> DataFrame:
    """A sample of ``year, line`` rows per year. A line's draw hangs on its year and text, so
    nothing is shuffled however large the files are; equal lines of a year share one draw."""
    return bernoulli_by_key(lines, ["year", "line"], fraction, seed)

"""Feature table to vectors: scaling, categories, assembly, temporal split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kerbside.operators.facts import split_by_time
from kerbside.operators.trailing import trailing_columns
from kerbside.operators.venues import OFFSETS, offset_column
from kerbside.operators.weather import MEASURES

ONE_HOT = ["Hour", "Day", "Month", "Day_Of_Week", "Day_Of_Year"]
ONE_BASED = ["Day", "Month", "Day_Of_Year"]
# Number of categories.
ARITY = {"Hour": 24, "Day": 31, "Month": 12, "Day_Of_Week": 7, "Day_Of_Year": 366, "Is_Holiday": 2}
SPLIT = datetime(2015, 1, 1)


def weather_columns(columns: Sequence[str]) -> list[str]:
    """Columns of single stations, ``TMIN_S1``, or a measure's vector over all stations, ``TMIN``."""
    prefixes = tuple(f"{m}_" for m in MEASURES)
    return [c for c in columns if c.startswith(prefixes) or c in MEASURES]


def venue_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in map(offset_column, OFFSETS) if c in columns]


_ONE_VECTOR = StructType([StructField("vector", VectorUDT())])


def _sparse(indices: Column, values: Column, width: int) -> Column:
    """A sparse vector from its ascending positions and its values.

    No SQL function builds one, but the JSON reader fills a column of any declared type, so
    the rows stay in the JVM.
    """
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"),
                     indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("vector"))), _ONE_VECTOR)["vector"]


def venue_vectors(df: DataFrame, width: int) -> DataFrame:
    """Lists of active venues, null or in venue order, as sparse vectors of ``width`` entries.

    Call it on one row per hour, before the lists are joined to the districts.
    """
    def vector(name: str) -> Column:
        entries = F.coalesce(F.col(f"`{name}`"), F.array().cast(df.schema[name].dataType))
        return _sparse(F.transform(entries, lambda e: e["venue_id"]), F.transform(entries, lambda e: e["n"].cast("double")), width)

    return df.withColumns({c: vector(c) for c in venue_columns(df.columns)})


def weather_vectors(arrays: DataFrame, stations: Sequence[str]) -> DataFrame:
    """``Date`` and one dense vector per measure out of a day's arrays by station number.

    The entries carry the stations' names, and the vectors their length, which is checked: an
    array of another length is an error, and so is a measure that no station has in the whole
    period, for which there is nothing to fill gaps with.
    """
    def vector(name: str) -> Column:
        wrong = (F.size(name) != len(stations)) | F.exists(name, lambda v: v.isNull())
        checked = F.when(wrong, F.raise_error(F.lit(f"{name}: not one value per station"))).otherwise(F.col(name))
        attrs = [{"idx": i, "name": s} for i, s in enumerate(stations)]
        meta = {"ml_attr": {"attrs": {"numeric": attrs}, "num_attrs": len(stations)}}
        return array_to_vector(checked).alias(name, metadata=meta)

    return arrays.select("Date", *[vector(m) for m in sorted(c for c in arrays.columns if c in MEASURES)])


def _rebased(df: DataFrame) -> DataFrame:
    """Categories counted from 0, as doubles that carry their number of values."""
    columns = {}
    for c, arity in ARITY.items():
        if c not in df.columns:
            continue
        value = F.col(c).cast("int").cast("double")
        if c in ONE_BASED:
            value = value - 1
        meta = {"ml_attr": {"type": "nominal", "name": c, "vals": [str(i) for i in range(arity)]}}
        columns[c] = value.alias(c, metadata=meta)
    return df.select(*[columns.get(c, F.col(f"`{c}`")) for c in df.columns])


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    pipeline: PipelineModel
    inputs: list[str] = field(default_factory=list)

    def feature_names(self) -> list[str]:
        """Name of every entry of the ``features`` vector, from the assembler's metadata."""
        attrs = self.train.schema["features"].metadata["ml_attr"]["attrs"]
        flat = [a for kind in attrs.values() for a in kind]
        return [a["name"] for a in sorted(flat, key=lambda a: a["idx"])]


def feature_columns(columns: Sequence[str]) -> list[str]:
    """The columns that are features, in the table's order: trailing counts, categories, weather
    and venues. Whatever else a table carries is none."""
    known = {*trailing_columns(), *ARITY, *weather_columns(columns), *venue_columns(columns)}
    return [c for c in columns if c in known]


def prepare(
    features: DataFrame,
    scale: bool = True,
    one_hot: bool = True,
    split: datetime = SPLIT,
    strict_reference: bool = False,
) -> Prepared:
    """Add ``features`` and ``label`` and split in time.

    Linear models want scaled counts and weather (unit deviation, not centred) and one
    column per category; forests take everything as it is, the categories' numbers of
    values being known from metadata. The scaler sees the training rows only, or with
    ``strict_reference`` all rows.
    """
    rebased = _rebased(features)
    columns = rebased.columns
    replaced: list[str] = []
    stages, appended = [], []
    if scale:
        to_scale = [c for c in trailing_columns() if c in columns] + weather_columns(columns)
        stages += [
            VectorAssembler(inputCols=to_scale, outputCol="to_scale"),
            StandardScaler(inputCol="to_scale", outputCol="scaled", withStd=True, withMean=False),
        ]
        replaced += to_scale
        appended.append("scaled")
    if one_hot:
        encoded = [c for c in ONE_HOT if c in columns]
        stages.append(OneHotEncoder(
            inputCols=encoded, outputCols=[f"{c}_vector" for c in encoded], dropLast=False))
        replaced += encoded
        appended += [f"{c}_vector" for c in encoded]
    inputs = [c for c in feature_columns(columns) if c not in replaced] + appended
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))

    train, test = split_by_time(rebased, split, strict_reference)
    fitted = Pipeline(stages=stages).fit(rebased if strict_reference else train)

    def finish(df: DataFrame) -> DataFrame:
        return fitted.transform(df).select(
            "Time", "Lat", "Lon", F.col("Pickup_Count").cast("double").alias("label"), "features")

    return Prepared(finish(train), finish(test), fitted, inputs)

"""Predictions of the districts' models, and their error table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.regression import LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.models.train import model_path, rows_of
from kerbside.operators.errors import district_errors
from kerbside.operators.sampling import bernoulli_by_key

MODEL_CLASSES = {"linear": LinearRegressionModel, "random_forest": RandomForestRegressionModel}
SAMPLING_SEED = 1234


def load_models(folder: str, kind: str, districts: Sequence[tuple[float, float]]) -> dict:
    """The saved models of the listed districts."""
    return {d: MODEL_CLASSES[kind].load(model_path(folder, *d)) for d in districts}


def sampled(rows: DataFrame, fraction: float = 1.0, seed: int = SAMPLING_SEED) -> DataFrame:
    """A share of the rows, for a cheaper evaluation; all of them by default. Whether a row is
    drawn hangs on its district and hour alone."""
    if fraction >= 1.0:
        return rows
    keys = [F.date_format("Time", "yyyyMMddHH"), geo.cell_of(F.col("Lat")), geo.cell_of(F.col("Lon"))]
    return bernoulli_by_key(rows, keys, fraction, seed)


def score_districts(table: DataFrame, models: Mapping, fraction: float = 1.0,
                    seed: int = SAMPLING_SEED) -> DataFrame:
    """``Time, Lat, Lon, prediction, label`` of all districts of a ``by_cell`` table.

    Every model transforms its own directory; time stays with the row, so nothing is
    zipped or collected.
    """
    def scored(district, model) -> DataFrame:
        rows = sampled(rows_of(table, *district), fraction, seed)
        return model.transform(rows).select("Time", "Lat", "Lon", "prediction", "label")

    return reduce(DataFrame.unionByName, [scored(d, m) for d, m in models.items()])


def evaluate(table: DataFrame, models: Mapping) -> DataFrame:
    return district_errors(score_districts(table, models))

"""One model per district."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.models.linear import RIDGE
from kerbside.models.prepare import ARITY
from kerbside.session import materialize_all

#: Fits that overlap on the driver. Each is a distributed job; the pool only keeps the
#: cluster busy between their stages.
PARALLEL_FITS = 8


def linear() -> LinearRegression:
    """The library's least squares through the origin with a small ridge term, for one district
    and vectors of at most 4,096 entries; ``models.linear`` has no such limit."""
    return LinearRegression(featuresCol="features", labelCol="label", fitIntercept=False, regParam=RIDGE,
                            elasticNetParam=0.0, standardization=True, solver="normal")


# Trees and depth of the published forests, the seed, and the names of saved models.
def forest(trees: int = 5, depth: int = 15, seed: int = 1234, categorical: bool = True) -> RandomForestRegressor:
    """A forest with enough bins for the widest category."""
    bins = max(32, max(ARITY.values())) if categorical else 32
    return RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees,
                                 maxDepth=depth, maxBins=bins, seed=seed)


def model_path(folder: str, lat: float, lon: float) -> str:
    return f"{folder.rstrip('/')}/model_{lat}_{lon}"


def by_cell(*prepared: DataFrame) -> list[DataFrame]:
    """Prepared rows as tables with one directory per district, so that a fit reads only
    its own rows however many districts there are."""
    cells = {"lat_cell": geo.cell_of(F.col("Lat")), "lon_cell": geo.cell_of(F.col("Lon"))}
    tables = {f"prepared-{i}": df.withColumns(cells) for i, df in enumerate(prepared)}
    return list(materialize_all(tables, partition_by=tuple(cells)).values())


def rows_of(table: DataFrame, lat: float, lon: float) -> DataFrame:
    """A district's directory of a ``by_cell`` table."""
    return table.filter((F.col("lat_cell") == round(lat * 100)) & (F.col("lon_cell") == round(lon * 100)))


def of_listed(table: DataFrame, districts: Sequence[tuple[float, float]]) -> DataFrame:
    """Rows of a ``by_cell`` table in the listed districts."""
    cells = [(round(lat * 100), round(lon * 100)) for lat, lon in districts]
    listed = table.sparkSession.createDataFrame(cells, "lat_cell int, lon_cell int").distinct()
    return table.join(F.broadcast(listed), ["lat_cell", "lon_cell"], "left_semi")


def train_districts(
    table: DataFrame,
    districts: Sequence[tuple[float, float]],
    estimator: Callable[[], object],
    folder: str | None = None,
    categorical: bool = True,
    parallel: int = PARALLEL_FITS,
) -> dict[tuple[float, float], object]:
    """Fit one model per listed district of a ``by_cell`` table, and save it if a folder is given.

    A tree cannot split a category into more values than it has rows. With ``categorical``
    listed districts that short are an error that names them; without, all districts take
    their categories as numbers. The choice is saved beside the models.
    """
    spark = table.sparkSession
    cells = [(round(lat * 100), round(lon * 100)) for lat, lon in districts]
    listed = table.sparkSession.createDataFrame(cells, "lat_cell int, lon_cell int").distinct()
    short = {
        (r.lat_cell, r.lon_cell)
        for r in table.join(F.broadcast(listed), ["lat_cell", "lon_cell"])
        .groupBy("lat_cell", "lon_cell").agg(F.count("*").alias("n"))
        .filter(F.col("n") < max(ARITY.values())).collect()
    }
    if categorical and short and isinstance(estimator(), RandomForestRegressor):
        raise ValueError(f"districts with fewer rows than a category has values: {sorted(short)}")
    if folder:
        spark.createDataFrame([(categorical,)], "categorical boolean").write.mode("overwrite").json(
            f"{folder.rstrip('/')}/settings")

    def fit(district: tuple[float, float]):
        own = rows_of(table, *district)
        if not categorical:
            own = own.withColumn("features", F.col("features").alias("features", metadata={}))
        model = estimator().fit(own)
        if folder:
            model.write().overwrite().save(model_path(folder, *district))
        return district, model

    with ThreadPoolExecutor(parallel) as pool:
        return dict(pool.map(fit, districts))


# ---- least squares for every district at once ------------------------------------------


def fit_linear_all(train: DataFrame, columns: Sequence[str], label: str = "Pickup_Count") -> DataFrame:
    """``Lat, Lon, rows, coefficients`` of a least-squares fit through the origin, for all
    districts in one job.

    The sums of products that the fit needs are ordinary aggregates: they combine on the
    map side, one row per district and task is shuffled, and no district's rows are ever
    brought together. Only the small solved system is left to Python.
    """
    k = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    y = F.col(label).cast("double")
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    moments = [F.sum(xi * y).alias(f"m{i}") for i, xi in enumerate(x)]
    sums = train.groupBy("Lat", "Lon").agg(F.count("*").alias("rows"), *products, *moments)
    packed = sums.select(
        "Lat", "Lon", "rows",
        F.array(*[F.col(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).alias("products"),
        F.array(*[F.col(f"m{i}") for i in range(k)]).alias("moments"))

    def solve(batches):
        rows, cols = np.triu_indices(k)
        for batch in batches:
            solved = []
            for products, moments in zip(batch["products"], batch["moments"], strict=True):
                gram = np.zeros((k, k))
                gram[rows, cols] = gram[cols, rows] = products
                # the shortest solution where a district's columns depend on each other
                solved.append(np.linalg.lstsq(gram, np.asarray(moments, dtype=float), rcond=None)[0])
            yield pd.DataFrame({"Lat": batch["Lat"], "Lon": batch["Lon"], "rows": batch["rows"],
                                "coefficients": solved})

    return packed.mapInPandas(solve, "Lat double, Lon double, rows long, coefficients array<double>")


def predict_linear_all(rows: DataFrame, models: DataFrame, columns: Sequence[str],
                       label: str = "Pickup_Count") -> DataFrame:
    """``Time, Lat, Lon, prediction, label`` from the per-district coefficients."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    keyed = {"lat_cell": geo.cell_of(F.col("Lat")), "lon_cell": geo.cell_of(F.col("Lon"))}
    weights = models.withColumns(keyed).select("lat_cell", "lon_cell", "coefficients")
    product = F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return (
        rows.withColumns(keyed).join(weights, ["lat_cell", "lon_cell"])
        .select("Time", "Lat", "Lon", product.alias("prediction"), F.col(label).cast("double").alias("label"))
    )

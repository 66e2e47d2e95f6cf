"""Linear fits of all districts from sums of products."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression

from kerbside.models import linear

SCHEMA = "Time timestamp_ntz, Lat double, Lon double, label double, features vector"


def rows_of(spark, draw, districts, rows, width, filled):
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("Time", T.TimestampNTZType()), T.StructField("Lat", T.DoubleType()),
                           T.StructField("Lon", T.DoubleType()), T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    data = []
    for d in range(districts):
        for k in range(rows):
            at = sorted(draw.sample(range(2, width - 3), filled))
            # a constant, two categories that depend on it, and others
            entries = {0: 1.0, width - 1 - k % 2: 1.0, 1: float(k % 5)} | {c: draw.uniform(-1, 3) for c in at}
            vector = Vectors.sparse(width, entries) if k % 3 else Vectors.dense(Vectors.sparse(width, entries).toArray())
            data.append((datetime(2024, 1, 1) + timedelta(hours=k), 40.7 + d / 100, -74.0, draw.uniform(0, 9) + 2 * entries[1], vector))
    return spark.createDataFrame(data, schema)


def coefficients(models, width):
    out = {}
    for r in models.collect():
        w = np.zeros(width)
        w[r["columns"]] = r["weights"]
        out[r["lat_cell"]] = (r["rows"], w)
    return out


def test_as_the_library_solves_it(spark):
    width = 12
    rows = rows_of(spark, random.Random(1), 3, 120, width, 4).cache()
    got = coefficients(linear.fit_all(rows), width)
    assert sorted(got) == [4070, 4071, 4072]
    for cell, (n, weights) in got.items():
        own = rows.filter(f"round(Lat * 100) = {cell}")
        library = LinearRegression(fitIntercept=False, regParam=linear.RIDGE, standardization=True, solver="normal").fit(own)
        assert n == 120 and weights == pytest.approx(library.coefficients.toArray(), abs=1e-8)


@pytest.mark.parametrize("block", [1024, 4])
def test_blocks_and_salts_do_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(linear, "BLOCK", block)
    monkeypatch.setattr(linear, "HELD", 50)
    rows = rows_of(spark, random.Random(2), 2, 90, 30, 6).cache()
    models = linear.fit_all(rows)
    dense = {}
    for r in rows.collect():
        dense.setdefault(round(r.Lat * 100), []).append((r.features.toArray(), r.label))
    for cell, (n, weights) in coefficients(models, 30).items():
        x, y = np.array([a for a, _ in dense[cell]]), np.array([b for _, b in dense[cell]])
        variance = x.var(0)
        keep = variance > 1e-9
        system = x[:, keep].T @ x[:, keep] / n + linear.RIDGE / y.std() * np.diag(variance[keep])
        assert weights[keep] == pytest.approx(np.linalg.solve(system, x[:, keep].T @ y / n), abs=1e-7)
        assert not weights[~keep].any()
    scored = {(r.Time, r.Lat): r.prediction for r in linear.predict_all(rows, models).collect()}
    assert len(scored) == rows.count()
    found = coefficients(models, 30)
    for r in rows.collect():
        assert scored[r.Time, r.Lat] == pytest.approx(float(r.features.toArray() @ found[round(r.Lat * 100)][1]), abs=1e-9)


def test_wide_vectors_of_many_districts(spark):
    rows = rows_of(spark, random.Random(3), 12, 60, 17_000, 60).cache()
    models = linear.fit_all(rows)
    assert models.count() == 12
    off = linear.gradients(rows, models).agg({"off": "max", "column": "count"}).first()
    assert off["max(off)"] < 1e-9 and off["count(column)"] > 12 * 2000


def test_empty(spark):
    rows = rows_of(spark, random.Random(4), 1, 5, 10, 2)
    models = linear.fit_all(rows.limit(0))
    assert models.count() == 0 and linear.predict_all(rows, models).count() == 0

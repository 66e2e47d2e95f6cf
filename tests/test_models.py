import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from conftest import at, tuples
from kerbside.models import forest, prepare, score, train
from kerbside.operators.trailing import trailing_columns
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = datetime(2014, 1, 11)


@pytest.fixture(scope="module")
def features(spark):
    """Two districts over 20 days, two stations, three venues."""
    r = random.Random(11)
    counts = trailing_columns()
    rows = []
    for h in range(20 * 24):
        t = at("2014-01-01 00:00:00") + timedelta(hours=h)
        for lat in (40.70, 40.71):
            past = [r.randrange(20) for _ in counts]
            rows.append((t, lat, -74.0, past[0] + t.hour // 6, *past, t.hour, t.weekday(), t.timetuple().tm_yday, t.day == 1,
                         float(r.randrange(30)), 5.0, [{"venue_id": 2, "n": 3}] if h % 2 else []))
    entry = T.StructType([T.StructField("venue_id", T.IntegerType()), T.StructField("n", T.LongType())])
    fields = [("Time", T.TimestampType()), ("Lat", T.DoubleType()), ("Lon", T.DoubleType()), ("Pickup_Count", T.LongType()),
              *[(c, T.LongType()) for c in counts], ("Hour", T.IntegerType()), ("Day_Of_Week", T.IntegerType()),
              ("Day_Of_Year", T.IntegerType()), ("Is_Holiday", T.BooleanType()), ("PRCP_A", T.DoubleType()),
              ("PRCP_B", T.DoubleType()), ("Venues_0h", T.ArrayType(entry))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return prepare.venue_vectors(spark.createDataFrame(rows, schema), 3).cache()


def test_venue_vectors(features):
    assert isinstance(features.schema["Venues_0h"].dataType, VectorUDT)
    first, second = [r.Venues_0h for r in features.orderBy("Time", "Lat").select("Venues_0h").limit(3).collect()][1:]
    assert first == SparseVector(3, {}) and second == SparseVector(3, {2: 3.0})


def test_venue_vectors_of_many_venues(spark):
    """An hour with 100,000 active venues, and one without a list, without Python in the plan."""
    entries = "transform(sequence(0, 99999), i -> named_struct('venue_id', i * 2, 'n', CAST(i % 9 AS BIGINT)))"
    df = spark.range(2).selectExpr("id", f"IF(id = 0, {entries}, NULL) AS Venues_0h")
    vectors = prepare.venue_vectors(df, 200_000)
    assert "Python" not in vectors._jdf.queryExecution().executedPlan().toString()
    full, empty = [r.Venues_0h for r in vectors.orderBy("id").collect()]
    assert full.size == empty.size == 200_000 and empty.numNonzeros() == 0
    assert len(full.indices) == 100_000 and full[199_998] == 99_999 % 9 and full[1] == 0


def test_forest_vectors_keep_categories(features):
    p = prepare.prepare(features, scale=False, one_hot=False, split=SPLIT)
    names = p.feature_names()
    assert names == trailing_columns() + ["Hour", "Day_Of_Week", "Day_Of_Year", "Is_Holiday", "PRCP_A", "PRCP_B",
                                          "Venues_0h_0", "Venues_0h_1", "Venues_0h_2"]
    nominal = p.train.schema["features"].metadata["ml_attr"]["attrs"]["nominal"]
    assert {a["name"]: len(a["vals"]) for a in nominal} == {"Hour": 24, "Day_Of_Week": 7, "Day_Of_Year": 366, "Is_Holiday": 2}
    row = p.test.orderBy("Time", "Lat").first()
    assert row.Time == SPLIT and row.features[names.index("Day_Of_Year")] == 10.0  # counted from 0
    assert p.train.count() == p.test.count() == 480


def test_other_columns_are_no_features(features):
    more = features.withColumns({"extra": F.lit(1.0), "Dropoff_Count": F.lit(3), "id": F.lit(7)})
    for scale, one_hot in ((True, True), (False, False)):
        names = [prepare.prepare(df, scale, one_hot, split=SPLIT).feature_names() for df in (features, more)]
        assert names[0] == names[1]


def test_one_hot_has_every_level(features):
    p = prepare.prepare(features, scale=False, one_hot=True, split=SPLIT)
    names = p.feature_names()
    assert sum(n.startswith("Hour_vector_") for n in names) == 24
    assert sum(n.startswith("Day_Of_Year_vector_") for n in names) == 366
    assert "Hour" not in names and "Is_Holiday" in names
    row = p.train.orderBy("Time", "Lat").first()
    assert row.features[names.index("Hour_vector_0")] == 1.0 and row.features[names.index("Day_Of_Year_vector_0")] == 1.0


def test_scaling_uses_training_rows_only(features):
    c = trailing_columns()[0]
    before = features.filter(F.col("Time") < F.lit(SPLIT))
    for strict, rows in ((False, before), (True, features)):
        p = prepare.prepare(features, scale=True, one_hot=False, split=SPLIT, strict_reference=strict)
        deviation = rows.agg(F.stddev_samp(c)).first()[0]
        at_0 = p.feature_names().index("scaled_0")
        row, raw = p.train.orderBy("Time", "Lat").first(), features.orderBy("Time", "Lat").first()
        assert row.features[at_0] == pytest.approx(raw[c] / deviation)
        assert row.features[p.feature_names().index("scaled_13")] == 0.0  # a constant column has no deviation
        assert p.test.filter(F.col("Time") == F.lit(SPLIT)).count() == (0 if strict else 2)


def test_least_squares_of_all_districts(spark, features):
    columns = trailing_columns()[:4] + ["Hour", "Day_Of_Week"]
    models = train.fit_linear_all(features, columns)
    predicted = {(r.Time, r.Lat): r.prediction for r in train.predict_linear_all(features, models, columns).collect()}
    pdf = features.select("Time", "Lat", "Pickup_Count", *columns).toPandas()
    for lat, rows in pdf.groupby("Lat"):
        x, y = rows[columns].to_numpy(float), rows["Pickup_Count"].to_numpy(float)
        w = np.linalg.lstsq(x, y, rcond=None)[0]
        got = models.filter(F.col("Lat") == lat).first()
        assert got.rows == len(rows) and np.allclose(got.coefficients, w)
        assert np.allclose([predicted[t, lat] for t in rows["Time"]], x @ w)


def test_dependent_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, float(i), 2.0 * i, 3 * i) for i in range(9)],
                               "Lat double, Lon double, a double, b double, Pickup_Count int")
    w = train.fit_linear_all(df, ["a", "b"]).first().coefficients
    assert w[0] + 2 * w[1] == pytest.approx(3.0)


def test_train_save_load_score(spark, features, tmp_path):
    p = prepare.prepare(features, split=SPLIT)
    rows, held_out = train.by_cell(p.train, p.test)
    listed = [(40.70, -74.0), (40.71, -74.0)]
    train.train_districts(rows, listed, train.linear, str(tmp_path))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["model_40.71_-74.0", "model_40.7_-74.0", "settings"]
    models = score.load_models(str(tmp_path), "linear", listed)
    assert all(m.intercept == 0.0 for m in models.values())
    got = score.evaluate(held_out, models)
    assert tuples(got, "Lat") == [(40.7,), (40.71,)] and got.agg(F.max("rmse")).first()[0] < 5
    assert 0 < score.score_districts(held_out, models, 0.5).count() < held_out.count()


def test_forests_of_short_districts(spark, features, tmp_path):
    p = prepare.prepare(features, scale=False, one_hot=False, split=SPLIT)
    rows, = train.by_cell(p.train)  # 240 rows per district: fewer than days of a year
    listed, estimator = [(40.70, -74.0)], lambda: train.forest(2, 3, categorical=False)
    model = train.train_districts(rows, listed, estimator, str(tmp_path), categorical=False)[40.70, -74.0]
    assert model.getNumTrees == 2
    assert not spark.read.json(str(tmp_path / "settings")).first().categorical
    with pytest.raises(ValueError, match="4070"):
        train.train_districts(rows, listed, lambda: train.forest(2, 3))


def test_linear_fit_solves_its_equations(spark, features):
    """Residuals are orthogonal to every column that varies, but for the ridge term, which
    weighs coefficients by their column's variance."""
    p = prepare.prepare(features, split=SPLIT)
    rows, = train.by_cell(p.train)
    own = train.rows_of(rows, 40.70, -74.0)
    model = train.train_districts(rows, [(40.70, -74.0)], train.linear)[40.70, -74.0]
    data = model.transform(own).select("features", "label", "prediction").collect()
    residual = sum((r.features.toArray() * (r.label - r.prediction) for r in data)) / len(data)
    variance = np.var([r.features.toArray() for r in data], axis=0, ddof=1)
    weighted = variance * model.coefficients.toArray()
    ridge = (residual @ weighted) / (weighted @ weighted)
    assert 0 < ridge <= train.RIDGE
    assert abs(residual - ridge * weighted)[variance > 0].max() < 1e-6


NODES = "tree int, node int, left int, right int, feature int, prediction double"


def hand_built(spark):
    """Tree 0: 7 at the root, 3 left, 7 below 3; tree 1: 3 at the root, 3 and 5 below."""
    rows = [
        (0, 0, 1, 6, 7, 0.0), (0, 1, 2, 5, 3, 0.0), (0, 2, 3, 4, 7, 0.0), (0, 3, None, None, None, 1.0),
        (0, 4, None, None, None, 1.0), (0, 5, None, None, None, 1.0), (0, 6, None, None, None, 1.0),
        (1, 0, 1, 4, 3, 0.0), (1, 1, 2, 3, 3, 0.0), (1, 2, None, None, None, 1.0), (1, 3, None, None, None, 1.0),
        (1, 4, 5, 6, 5, 0.0), (1, 5, None, None, None, 1.0), (1, 6, None, None, None, 1.0),
    ]
    return spark.createDataFrame(rows, NODES)


def test_levels_and_importance(spark):
    splits = forest.splits_by_level(hand_built(spark), max_level=3)
    assert tuples(splits) == [(0, 3, 1), (0, 7, 0), (0, 7, 2), (1, 3, 0), (1, 3, 1), (1, 5, 1)]
    assert [tuple(r) for r in forest.importance(splits).collect()] == [(3, 2.0), (7, 1.25), (5, 0.5)]
    assert [tuple(r) for r in forest.importance(splits, 1).collect()] == [(3, 2.0)]
    assert tuples(forest.top_features(splits, 0)) == [(3,), (7,)]
    assert (0, 2, 7, 1) in tuples(forest.feature_counts(splits), "tree", "level", "feature", "uses")
    assert [r.feature for r in forest.named(forest.importance(splits), list("abcdefgh")).collect()] == ["d", "h", "f"]


def test_every_level_counts(spark):
    """A tree that is one long chain: node 2k splits into leaf 2k + 1 and node 2k + 2."""
    depth = 30
    rows = [(0, 2 * k, 2 * k + 1, 2 * k + 2, k % 4, 0.0) for k in range(depth)]
    rows += [(0, n, None, None, None, 1.0) for n in [*range(1, 2 * depth, 2), 2 * depth]]
    splits = forest.splits_by_level(spark.createDataFrame(rows, NODES))
    assert tuples(splits) == sorted(((0, k % 4, k) for k in range(depth)), key=repr)


def test_deep_nodes_are_left_out_on_request(spark):
    assert tuples(forest.splits_by_level(hand_built(spark), max_level=1)) == [
        (0, 3, 1), (0, 7, 0), (1, 3, 0), (1, 3, 1), (1, 5, 1)]

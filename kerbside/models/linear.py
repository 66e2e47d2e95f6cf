"""Ridge regression through the origin on sparse vectors of any width, for all districts at once.

The fit needs sums of products of a row's entries only. Rows are dealt by district and a salt;
a task sums the products of the non-zero entries of its rows, label and a constant among
them, and the partial sums of each pair of columns are added up per district. No district's
rows are ever brought together, and what is (its sums) is bounded by its columns.

Each district's equations are then solved by conjugate gradients, preconditioned by diagonal
blocks that are inverted exactly, so a narrow system is solved at once and a wide one never
becomes a dense matrix. As in the library's solver the ridge term weighs coefficients of
standardised columns for a standardised label, and a column without variance has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.session import materialize

#: Weight of the squared coefficients: columns of one category depend on each other exactly.
RIDGE = 1e-3

#: Parts a district's rows are dealt to, and rows whose products are formed at a time.
SALTS, ROWS = 16, 64

#: Sums held before they are merged, and sums per batch handed on.
HELD, HANDED = 2_000_000, 100_000

#: Columns per block of the preconditioner, and the relative residual at which a solution stands.
BLOCK, TOLERANCE = 1024, 1e-13

#: Rows of a district scored in one group.
SCORED_ROWS = 50_000

#: Columns beyond the vector's: the label and a constant.
LABEL, ONE = 1 << 30, (1 << 30) + 1

_CELLS = ["lat_cell", "lon_cell"]


def _with_cells(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat_cell": geo.cell_of(F.col("Lat")), "lon_cell": geo.cell_of(F.col("Lon"))})


def entries(vectors: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns and values of the non-zero entries of each vector."""
    for v in vectors:
        values = np.asarray(v["values"].values)
        if v["type"].as_py() == 0:
            columns = np.asarray(v["indices"].values, dtype=np.int64)
            yield columns[values != 0], values[values != 0]
        else:
            columns = np.flatnonzero(values)
            yield columns, values[columns]


def _merged(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(sums), len(found))


def _products(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns, as one number each, and the sums of their products over some rows."""
    keys, sums = [], []
    for (columns, values), label in zip(entries(batch.column("features")), batch.column("label").to_pylist(), strict=True):
        columns, values = np.append(columns, (LABEL, ONE)), np.append(values, (label, 1.0))
        i, j = np.triu_indices(len(columns))
        keys.append(columns[i] << 31 | columns[j])
        sums.append(values[i] * values[j])
    return _merged(keys, sums)


def gram_sums(rows: DataFrame) -> DataFrame:
    """``lat_cell, lon_cell, i, j, total``: sums of products of columns ``i <= j`` per district."""
    dealt = _with_cells(rows).select(*_CELLS, "label", "features", F.pmod(F.xxhash64("Time"), F.lit(SALTS)).alias("salt"))
    dealt = dealt.repartition(*_CELLS, "salt").sortWithinPartitions(*_CELLS).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, int] | None = None
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []

        def handed() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            k, s = _merged(keys, sums)
            for at in range(0, len(k), HANDED):
                part = k[at:at + HANDED]
                cells = [pa.array(np.full(len(part), c, np.int32)) for c in current]
                yield pa.RecordBatch.from_arrays(
                    [*cells, pa.array((part >> 31).astype(np.int32)), pa.array((part & (1 << 31) - 1).astype(np.int32)),
                     pa.array(s[at:at + HANDED])], [*_CELLS, "i", "j", "total"])

        for batch in batches:
            lat, lon = (batch.column(c).to_numpy() for c in _CELLS)
            cuts = np.flatnonzero((np.diff(lat) != 0) | (np.diff(lon) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if current != (int(lat[low]), int(lon[low])):
                    yield from handed()
                    current, keys, sums = (int(lat[low]), int(lon[low])), [], []
                for at in range(low, high, ROWS):
                    k, s = _products(batch.slice(at, min(ROWS, high - at)))
                    keys.append(k)
                    sums.append(s)
                    if sum(map(len, keys)) > HELD:
                        k, s = _merged(keys, sums)
                        keys, sums = [k], [s]
        yield from handed()

    parts = dealt.mapInArrow(run, "lat_cell int, lon_cell int, i int, j int, total double")
    return parts.groupBy(*_CELLS, "i", "j").agg(F.sum("total").alias("total"))


def _spread(squares: float, total: float, n: float) -> float:
    """Deviation of the label; of a constant one its size, and 1 if that is zero."""
    mean = total / n
    variance = squares / n - mean * mean
    return float(np.sqrt(variance)) if variance > 1e-12 * squares / n else abs(mean) or 1.0


def solve(i: np.ndarray, j: np.ndarray, total: np.ndarray, ridge: float = RIDGE) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, columns and coefficients from one district's sums of products."""
    n = float(total[(i == ONE) & (j == ONE)][0])
    own = j < LABEL
    columns = np.unique(i[own])
    size = len(columns)

    def column(key: int) -> np.ndarray:
        out = np.zeros(size)
        at = (j == key) & (i < LABEL)
        out[np.searchsorted(columns, i[at])] = total[at]
        return out

    a, b, g = np.searchsorted(columns, i[own]), np.searchsorted(columns, j[own]), total[own] / n
    moments, means = column(LABEL) / n, column(ONE) / n
    diagonal = np.zeros(size)
    diagonal[a[a == b]] = g[a == b]
    variance = diagonal - means * means
    ridge = ridge / _spread(float(total[(i == LABEL) & (j == LABEL)][0]), float(total[(i == LABEL) & (j == ONE)][0]), n)
    varies = variance > 1e-12 * np.maximum(diagonal, 1e-300)
    place = np.cumsum(varies) - 1
    scale = 1 / np.sqrt(variance[varies])
    keep = varies[a] & varies[b]
    a, b, g = place[a[keep]], place[b[keep]], g[keep]
    g = g * scale[a] * scale[b]
    right, m = moments[varies] * scale, int(varies.sum())
    if m == 0:
        return int(n), columns, np.zeros(size)
    off = a != b
    diagonal = np.bincount(a[~off], g[~off], m) + ridge

    def times(x: np.ndarray) -> np.ndarray:
        return diagonal * x + np.bincount(a[off], g[off] * x[b[off]], m) + np.bincount(b[off], g[off] * x[a[off]], m)

    inverses = []
    for low in range(0, m, BLOCK):
        high = min(m, low + BLOCK)
        block = np.diag(diagonal[low:high])
        inside = off & (a >= low) & (a < high) & (b >= low) & (b < high)
        block[a[inside] - low, b[inside] - low] = block[b[inside] - low, a[inside] - low] = g[inside]
        inverses.append(np.linalg.inv(block))

    def preconditioned(r: np.ndarray) -> np.ndarray:
        return np.concatenate([inv @ r[k * BLOCK:k * BLOCK + BLOCK] for k, inv in enumerate(inverses)])

    x, r = np.zeros(m), right.copy()
    best, best_norm, enough = x, np.linalg.norm(r), TOLERANCE * np.linalg.norm(right)
    z = p = preconditioned(r)
    product = r @ z
    for _ in range(10 * m + 50):
        if best_norm <= enough or product <= 0:
            break
        q = times(p)
        step = product / (p @ q)
        x = x + step * p
        r = r - step * q
        if (norm := float(np.linalg.norm(r))) < best_norm:
            best, best_norm = x, norm
        z = preconditioned(r)
        product, before = r @ z, product
        p = z + product / before * p
    weights = np.zeros(size)
    weights[varies] = best * scale
    return int(n), columns, weights


def fit_all(rows: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """``lat_cell, lon_cell, rows, columns, weights`` of all districts of ``Time, Lat, Lon, label,
    features``: coefficients of the columns that have entries. Written."""
    sums = gram_sums(rows).repartition(*_CELLS).sortWithinPartitions(*_CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        current = None

        def solved() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting)
            n, columns, weights = solve(*(t.column(c).to_numpy() for c in ("i", "j", "total")), ridge)
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0]], pa.int32()), pa.array([current[1]], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([columns], pa.list_(pa.int32())), pa.array([weights], pa.list_(pa.float64()))],
                [*_CELLS, "rows", "columns", "weights"])

        for batch in batches:
            lat, lon = (batch.column(c).to_numpy() for c in _CELLS)
            cuts = np.flatnonzero((np.diff(lat) != 0) | (np.diff(lon) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                cell = (int(lat[low]), int(lon[low]))
                if waiting and cell != current:
                    yield solved()
                    waiting = []
                current = cell
                waiting.append(batch.slice(low, high - low))
        if waiting:
            yield solved()

    return materialize(sums.mapInArrow(
        run, "lat_cell int, lon_cell int, rows bigint, columns array<int>, weights array<double>"), "linear-models")


def save(models: DataFrame, folder: str) -> None:
    """All districts' models as one table."""
    models.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/linear")


def load(spark: SparkSession, folder: str, districts: Sequence[tuple[float, float]]) -> DataFrame:
    """The saved models of the listed districts; one that is missing is an error."""
    cells = {(round(lat * 100), round(lon * 100)) for lat, lon in districts}
    listed = F.broadcast(spark.createDataFrame(sorted(cells), "lat_cell int, lon_cell int"))
    models = spark.read.parquet(f"{folder.rstrip('/')}/linear").join(listed, _CELLS, "left_semi")
    missing = cells - {tuple(r) for r in models.select(*_CELLS).collect()}
    if missing:
        raise ValueError(f"no model of districts {sorted(missing)}")
    return models


def predict_all(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``Time, Lat, Lon, prediction, label`` of the rows whose district has a model.

    A district's rows are dealt to groups of about ``SCORED_ROWS``, each of which receives its
    coefficients once.
    """
    keyed = _with_cells(rows)
    groups = keyed.groupBy(*_CELLS).agg(F.ceil(F.count("*") / SCORED_ROWS).cast("int").alias("groups"))
    groups = materialize(groups, "score-groups")
    dealt = keyed.join(groups, _CELLS).withColumn("part", F.pmod(F.xxhash64("Time"), F.col("groups")).cast("int")) \
        .select(*_CELLS, "part", "Time", "Lat", "Lon", "label", "features")
    sent = models.join(groups, _CELLS).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))) \
        .select(*_CELLS, "part", "columns", "weights")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["Time", "Lat", "Lon", "label"])
        if not right.num_rows or not left.num_rows:
            return out.slice(0, 0).append_column("prediction", pa.array([], pa.float64()))
        model = right.slice(0, 1).to_pylist()[0]
        columns = np.array(model["columns"], np.int64)
        weights = np.append(np.array(model["weights"]), 0.0)
        found = []
        for at, values in (e for chunk in left.column("features").chunks for e in entries(chunk)):
            place = np.searchsorted(columns, at)
            known = (place < len(columns)) & (np.append(columns, -1)[place] == at)
            found.append(float(weights[np.where(known, place, len(columns))] @ values))
        return out.append_column("prediction", pa.array(found, pa.float64()))

    time = rows.schema["Time"].dataType.simpleString()
    scored = dealt.groupBy(*_CELLS, "part").cogroup(sent.groupBy(*_CELLS, "part")).applyInArrow(
        score, f"Time {time}, Lat double, Lon double, label double, prediction double")
    return scored.select("Time", "Lat", "Lon", "prediction", "label")


def gradients(rows: DataFrame, models: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """``Lat, Lon, column, off``: how far a fit is from the point where no change of a column's
    coefficient helps, relative to the column's and the label's size. Taken from the rows
    themselves, by their residuals."""
    scored = predict_all(rows, models).withColumn("residual", F.col("label") - F.col("prediction"))
    both = rows.join(scored.select("Time", "Lat", "Lon", "residual"), ["Time", "Lat", "Lon"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(entries(b.column("features")))
            owner = pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c, _ in found]))
            yield pa.RecordBatch.from_arrays(
                [b.column("Lat").take(owner), b.column("Lon").take(owner), pa.array(np.concatenate([c for c, _ in found]), pa.int32()),
                 pa.array(np.concatenate([v for _, v in found])), b.column("residual").take(owner)], ["Lat", "Lon", "column", "x", "residual"])

    x = F.col("x")
    sums = both.select("Lat", "Lon", "features", "residual").mapInArrow(
        run, "Lat double, Lon double, column int, x double, residual double",
    ).groupBy("Lat", "Lon", "column").agg(
        F.sum(x * F.col("residual")).alias("product"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))
    label = rows.groupBy("Lat", "Lon").agg(
        F.sum(F.col("label") * F.col("label")).alias("label_squares"), F.sum("label").alias("label_total"))
    weights = models.select(*_CELLS, "rows", F.inline(F.arrays_zip("columns", "weights"))) \
        .withColumnsRenamed({"columns": "column", "weights": "weight"})
    n = F.col("rows")
    variance = F.col("squares") / n - F.pow(F.col("total") / n, F.lit(2))
    varies = variance > 1e-9 * F.col("squares") / n
    label_mean, label_mean_square = F.col("label_total") / n, F.col("label_squares") / n
    label_variance = label_mean_square - label_mean * label_mean
    spread = F.when(label_variance > 1e-12 * label_mean_square, F.sqrt(label_variance)) \
        .when(label_mean != 0, F.abs(label_mean)).otherwise(F.lit(1.0))
    size = F.sqrt(F.col("squares") * F.col("label_squares")) + F.lit(1e-300)
    return _with_cells(sums.join(label, ["Lat", "Lon"])).join(weights, [*_CELLS, "column"]).select(
        "Lat", "Lon", "column", F.when(varies, F.abs(F.col("product") - n * ridge / spread * variance * F.col("weight")) / size)
        .otherwise(F.lit(0.0)).alias("off"))

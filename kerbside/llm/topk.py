"""Exact top-k inner products by segment statistics at several resolutions.

Vectors are cut into segments, coarse to fine. From a segment's mean and deviation of a
vector and of a query follows a bound: over a segment of ``l`` components,

    |x - q|^2 >= l * ((mean_x - mean_q)^2 + (dev_x - dev_q)^2),

so the sum over segments is a lower bound of the distance, and since
``2 x.q = |x|^2 + |q|^2 - |x - q|^2`` an upper bound of the inner product. Finer segments
bound tighter. A query's k-th best score so far closes all vectors whose bound stays below
it; what survives the finest level is scored exactly, in integers.

Rows are packed into blocks of bounded size. Every block of vectors meets every block of
queries once, and only the k best of each query leave a meeting; so neither a query nor a
vector is ever gathered whole in one place.

Cases: vectors that are null, empty, or hold a null or a component that is not finite take
no part, neither do rows without an id. Vectors of another length than the query's are no
candidates of it. A query's own row is none either; other rows with its id are, and each of
repeated ids asks for itself. Ties go to the smaller id. Fewer than k candidates are all
returned. Other columns are ignored. A component or one of the best scores beyond 64 bits is
an error, since no long can hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.llm.common import write_table

#: Rows of a block of vectors and of a block of queries.
VECTORS, QUERIES = 4096, 1024

#: Segments per vector at each level.
LEVELS = (4, 16)

K, SCALE, QUERY_EVERY = 10, 1024, 100


#: A double of this size or more is beyond a 64-bit integer.
BEYOND_LONG = 2.0 ** 63


def _integers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, size, v``: ids and integer components of the vectors that take part."""
    def whole(x: Column) -> Column:
        return F.when(F.abs(x * scale) >= BEYOND_LONG, F.raise_error(F.lit("component beyond 64 bits"))).otherwise(
            F.floor(x * scale).cast("bigint"))

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter("vec_id is not null and embedding is not null and size(embedding) > 0").filter(finite) \
        .select("vec_id", F.size("embedding").alias("size"),
                F.transform("embedding", whole).alias("v"))


def _packed(size: int, columns: dict[str, list], data: list[np.ndarray]) -> pa.RecordBatch:
    packed = {n: np.array(v, "<i8") for n, v in columns.items()} | {"data": np.stack(data).astype("<i8")}
    return pa.RecordBatch.from_arrays(
        [pa.array([size], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in packed.values()]], ["size", *packed])


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows in numbered blocks of at most ``most``: ``block, size, ids, asks, data`` (64-bit
    integers). Block and place in it tell rows apart, whatever their ids."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[dict[str, list], list[np.ndarray]]] = {}
        for b in batches:
            flat, at = np.asarray(b.column("v").flatten()), 0
            for i, size, asks in zip(*(b.column(c).to_pylist() for c in ("vec_id", "size", "asks")), strict=True):
                columns, data = waiting.setdefault(size, ({"ids": [], "asks": []}, []))
                columns["ids"].append(i)
                columns["asks"].append(bool(asks))
                data.append(flat[at:at + size])
                at += size
                if len(data) == most:
                    yield _packed(size, *waiting.pop(size))
        for size, held in waiting.items():
            yield _packed(size, *held)

    packed = rows.mapInArrow(pack, "size int, ids binary, asks binary, data binary")
    return rows.sparkSession.read.parquet(write_table(
        packed.withColumn("block", F.monotonically_increasing_id()), "vector-blocks"))


def _query_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """The asking rows of the blocks in blocks of their own: ``query_block, size, query_ids,
    home, place, query_data``, with the block and the place in it that each comes from."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[dict[str, list], list[np.ndarray]]] = {}
        for b in batches:
            for block, size, *packed in zip(*(b.column(c).to_pylist() for c in ("block", "size", "ids", "asks", "data")), strict=True):
                ids, asks, data = (np.frombuffer(p, "<i8") for p in packed)
                for place in np.flatnonzero(asks):
                    columns, held = waiting.setdefault(size, ({"ids": [], "home": [], "place": []}, []))
                    for name, value in (("ids", ids[place]), ("home", block), ("place", place)):
                        columns[name].append(value)
                    held.append(data.reshape(-1, size)[place].copy())
                    if len(held) == most:
                        yield _packed(size, *waiting.pop(size))
        for size, held in waiting.items():
            yield _packed(size, *held)

    packed = blocks.select("block", "size", "ids", "asks", "data").mapInArrow(
        pack, "size int, ids binary, home binary, place binary, data binary")
    written = blocks.sparkSession.read.parquet(write_table(
        packed.withColumn("query_block", F.monotonically_increasing_id()), "query-blocks"))
    return written.withColumnsRenamed({"ids": "query_ids", "data": "query_data"})


def _statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the segments, and each row's means and deviations times root of length."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lengths = np.diff(cuts).astype(float)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    mean = total / lengths
    variance = np.maximum(np.add.reduceat(x * x, cuts[:-1], axis=1) / lengths - mean * mean, 0)
    return lengths, mean * np.sqrt(lengths), np.sqrt(variance * lengths)


def meet(
    ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and scores of its k best vectors among ``x``; ties to smaller ids. ``own``
    is the query's place in ``x``, -1 where it is not among them."""
    xf, qf = x.astype(float), q.astype(float)
    levels = []
    for segments in LEVELS:
        (_, mx, dx), (_, mq, dq) = _statistics(xf, segments), _statistics(qf, segments)
        levels.append((np.hstack([mx, dx]), np.hstack([mq, dq])))
    # |x|^2 and |q|^2 equal the squared norms of their statistics, at every level; a bound of
    # x.q is therefore the inner product of the statistics. The slack covers rounding.
    slack = 1e-9 * (np.sqrt((xf * xf).sum(1))[:, None] * np.sqrt((qf * qf).sum(1))[None, :]) + 1e-6
    bound = levels[0][0] @ levels[0][1].T + slack
    places = np.arange(len(ids))

    def scored(rows: np.ndarray, j: int) -> np.ndarray:
        if np.any(np.abs(xf[rows] @ qf[j]) >= BEYOND_LONG):
            raise OverflowError("score beyond 64 bits")
        return x[rows] @ q[j]

    for j, place in enumerate(own):
        allowed = places != place
        upper = np.where(allowed, bound[:, j], -np.inf)
        seed = np.argpartition(-upper, min(k, len(ids)) - 1)[:k]
        seed = seed[allowed[seed]]
        least = np.sort(scored(seed, j))[-k] if len(seed) >= k else -np.inf
        alive = np.flatnonzero(upper >= least)
        for sx, sq in levels[1:]:
            alive = alive[sx[alive] @ sq[j] + slack[alive, j] >= least]
        alive = alive[allowed[alive]]
        scores = scored(alive, j)
        order = np.lexsort((ids[alive], -scores))[:k]
        yield ids[alive][order], scores[order]


def top_k(
    vectors: DataFrame, k: int = K, scale: int = SCALE, query_every: int = QUERY_EVERY, is_query: Column | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of every query.

    Queries are the rows that ``is_query`` selects, by default those whose id is divisible
    by ``query_every``.
    """
    asks = F.pmod("vec_id", F.lit(query_every)) == 0 if is_query is None else is_query
    data = _blocks(_integers(vectors, scale).withColumn("asks", F.coalesce(asks, F.lit(False))), VECTORS)
    parts = _query_blocks(data, QUERIES)
    pairs = data.select("block", "size").join(parts.select("size", "query_block"), "size")
    meetings = pairs.join(data.drop("size", "asks"), "block").join(parts.drop("size"), "query_block") \
        .repartition("block", "query_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "size", "ids", "data", "query_ids", "home", "place", "query_data")
        for b in batches:
            for block, size, *packed in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                ids, x, query_ids, home, place, q = (np.frombuffer(p, "<i8") for p in packed)
                own = np.where(home == block, place, -1)
                found = list(meet(ids, x.reshape(-1, size), own, q.reshape(-1, size), k))
                n = [len(f[0]) for f in found]
                columns = [np.repeat(c, n) for c in (home, place, query_ids)] + [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["home", "place", "query_id", "vec_id", "score"])

    best = meetings.mapInArrow(run, "home bigint, place bigint, query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")

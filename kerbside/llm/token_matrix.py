"""Packed id matrices by best fit decreasing.

A document longer than a window gives whole windows, which need no packing, and a rest.
Rests are packed best fit decreasing: the longest first, each into the bin with the least
sufficient room. Rests of one length are alike, so the course of the packing follows from
the number of rests of each length alone. It is computed from that histogram, at most
``window`` numbers however large the corpus, with runs of equal bins in place of single
ones; a segment tree over the capacities finds the least sufficient one. What comes out
are ranges: the rests of a length ranked from .. to lie in bins from .. at a given offset.

Each row of the matrix has ``window`` ids, the cumulative lengths of its segments and
positions that start from 0 in every segment. Documents are split without loss: ``starts``
says where in its document each segment begins.

Cases: a null or empty text is its end id alone. A null id is kept. Repeated rows are packed
each for itself. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.llm.common import map_batches, slices
from kerbside.llm.packing import WINDOW, part_offsets
from kerbside.llm.tokens import encoder, loaded, stored, write_tokens
from kerbside.sizing import broadcast_if_bounded


class CapacityTree:
    """Segment tree over capacities 0 .. n: which ones have bins, and the least from a bound."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, capacity: int, some: bool) -> None:
        k = capacity + self.size
        self.some[k] = some
        while k > 1:
            k //= 2
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def least(self, bound: int) -> int | None:
        """The least capacity of at least ``bound`` that has bins."""
        k = bound + self.size
        if not self.some[k]:
            while k > 1 and (k % 2 or not self.some[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.some[2 * k] else 2 * k + 1
        return k - self.size


#: Ranges of one length: first rank of each, its first bin, its offset within the bins.
Ranges = tuple[np.ndarray, np.ndarray, np.ndarray]


def best_fit(counts: Mapping[int, int], window: int) -> tuple[dict[int, Ranges], int]:
    """Where best fit decreasing puts ``counts[length]`` items of each length; number of bins."""
    tree = CapacityTree(window)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # by capacity: first bin, number
    found: dict[int, Ranges] = {}
    bins = 0

    def put(capacity: int, first: int, number: int) -> None:
        if number:
            runs[capacity].append((first, number))
            tree.set(capacity, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank, rows = counts[length], 0, []
        while left:
            capacity = tree.least(length)
            if capacity is None:
                capacity = window
                first, number = bins, -(-left // (window // length))
                bins += number
            else:
                first, number = runs[capacity].pop()
                tree.set(capacity, bool(runs[capacity]))
            each = capacity // length
            filled = min(number, left // each)
            for k in range(each if filled else 0):
                rows.append((rank, first, window - capacity + k * length))
                rank += filled
            left -= filled * each
            put(capacity - each * length, first, filled)
            if filled < number:
                some = min(left, each)
                for k in range(some):
                    rows.append((rank, first + filled, window - capacity + k * length))
                    rank += 1
                left -= some
                put(capacity - some * length, first + filled, 1)
                put(capacity, first + filled + 1, number - filled - 1)
        found[length] = tuple(np.array(c, np.int64) for c in zip(*rows, strict=True))
    return found, bins


SEGMENTS = "sequence_id bigint, offset int, doc_id bigint, start bigint, segment binary"

MATRIX = (
    "sequence_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<bigint>, starts array<bigint>")


def _segments(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Every segment with its sequence and offset."""
    spark = docs.sparkSession
    tokens = spark.read.parquet(write_tokens(docs, path, end_id, window))
    parts = tokens.agg(F.max("part")).first()[0] or 0
    rests = tokens.groupBy("part", "rest").count()
    counts = {r["rest"]: r["n"] for r in rests.groupBy("rest").agg(F.sum("count").alias("n")).collect() if r["rest"]}
    ranges, _ = best_fit(counts, window)
    whole = tokens.agg(F.sum(F.expr(f"tokens div {window}")).alias("n")).first()["n"] or 0
    earlier = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    rank_base = rests.select("part", "rest", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("rank_base"))
    full_base = part_offsets(tokens.withColumn("full", F.expr(f"tokens div {window}")), "full", "full_base")
    placed = (
        tokens.join(broadcast_if_bounded(full_base, parts + 1), "part")
        .join(broadcast_if_bounded(rank_base, (parts + 1) * window), ["part", "rest"])
        .select("doc_id", "ids", "rest", (F.col("full_base") + F.col("full_before")).alias("full"),
                (F.col("rank_base") + F.col("rest_rank")).alias("rank")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = encoder(path)[1]
        rows: list[tuple] = []
        for doc, data, rest, full, rank in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "rest", "full", "rank")), strict=True):
            ids = loaded(data, size)
            n = len(ids) // window
            rows += [(full + k, 0, doc, k * window, stored(ids[k * window:(k + 1) * window], size)) for k in range(n)]
            if rest:
                ranks, first, offset = ranges[rest]
                k = int(np.searchsorted(ranks, rank, "right")) - 1
                rows.append((whole + int(first[k]) + rank - int(ranks[k]), int(offset[k]), doc, n * window,
                             stored(ids[n * window:], size)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["sequence_id", "offset", "doc_id", "start", "segment"])

    return map_batches(placed, cut, SEGMENTS)


def packed_matrix(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """One row per sequence: ``ids`` (unsigned 32-bit, little-endian, ``window`` of them),
    ``cu_seqlens`` (0, then where each segment ends), ``positions`` (unsigned 32-bit,
    counted from 0 in each segment and in the padding), ``doc_ids`` and ``starts``."""
    segments = _segments(docs, path, window, end_id)
    ordered = segments.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = encoder(path)[1]
        counting = np.arange(window, dtype="<u4")
        names = ("sequence_id", "doc_id", "start", "segment")

        def row(sequence: int, parts: list[tuple]) -> tuple:
            pieces = [loaded(p[2], size) for p in parts]
            ends = np.cumsum([0, *map(len, pieces)])
            positions = np.concatenate([counting[:len(p)] for p in pieces] + [counting[:window - ends[-1]]])
            ids = np.concatenate([*pieces, np.full(window - ends[-1], pad_id, "<u4")])
            return (sequence, int(ends[-1]), ids.tobytes(), ends.tolist(), positions.tobytes(),
                    [p[0] for p in parts], [p[1] for p in parts])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(),
                     pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["sequence_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"])

        current, parts, rows = None, [], []
        for batch in slices(batches):
            for sequence, *part in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if sequence != current and parts:
                    rows.append(row(current, parts))
                    parts = []
                current = sequence
                parts.append(tuple(part))
            if rows:
                yield made(rows)
                rows = []
        if parts:
            yield made([row(current, parts)])

    return ordered.mapInArrow(assemble, MATRIX)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ``ids`` and ``positions`` are fixed-length binary rows,
    ready to be viewed as unsigned 32-bit matrices."""
    matrix.write.option("compression", "zstd").parquet(path)


def written_matrix(docs: DataFrame, path: str, folder: str, window: int = WINDOW, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """The packed matrix of ``docs``, written to ``folder`` and read back from its files."""
    write_matrix(packed_matrix(docs, path, window, end_id, pad_id), folder)
    return docs.sparkSession.read.schema(MATRIX).parquet(folder)


def matrix_digests(matrix: DataFrame) -> DataFrame:
    """Per sequence: its documents, starts and segment ends, and checksums of ids and positions."""
    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = [pa.array([zlib.crc32(x) for x in batch.column(c).to_pylist()], pa.int64()) for c in ("ids", "positions")]
        kept = ["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens"]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], *sums], [*kept, "ids_crc32", "positions_crc32"])

    return map_batches(matrix, digest, (
        "sequence_id bigint, n_tokens int, doc_ids array<bigint>, starts array<bigint>, "
        "cu_seqlens array<int>, ids_crc32 bigint, positions_crc32 bigint"))

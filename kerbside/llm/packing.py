"""Packing by concatenating and cutting.

All documents, each ended by one id, form one long row of tokens that is cut every
``window`` tokens. Two passes: tokens are written with running sums inside each partition;
sums of partition totals then give every document its place in the whole, and with it the
pieces into which the windows cut it. No document moves, and only the very last sequence
is not full. A piece is the record of one document's stretch in one sequence.

Cases: a null or empty text is its end id alone. A null id is kept. Repeated rows are packed
each for itself. An empty table has no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.llm.common import map_batches
from kerbside.llm.tokens import encoder, loaded, stored, write_tokens
from kerbside.sizing import broadcast_if_bounded

WINDOW = 1024

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint")


def part_offsets(tokens: DataFrame, column: str, total: str) -> DataFrame:
    """``part`` and the sum of ``column``'s totals over all parts before it: one row per
    task of the pass that wrote the tokens, so the one running sum stays small."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return tokens.groupBy("part").agg(F.sum(column).alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(total))


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: which stretch of a document lies where in which sequence.

    ``path`` is a tokenizer file. With ``with_ids`` each piece also carries its ids
    (``piece``, two or four bytes each), for ``sequences``.
    """
    spark = docs.sparkSession
    tokens = spark.read.parquet(write_tokens(docs, path, end_id, window))
    offsets = part_offsets(tokens, "tokens", "base")
    parts = tokens.agg(F.max("part")).first()[0]
    placed = tokens.join(broadcast_if_bounded(offsets, (parts or 0) + 1), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("begin"), "ids")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = encoder(path)[1]
        rows: list[tuple] = []
        owners = []
        for k, (begin, data) in enumerate(zip(batch.column("begin").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
            ids = loaded(data, size)
            first = -(begin % window)
            for low in range(first, len(ids), window):
                a, b = max(low, 0), min(low + window, len(ids))
                rows.append((a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids),
                             (begin + a) // window, (begin + a) % window)
                            + ((stored(ids[a:b], size),) if with_ids else ()))
                owners.append(k)
        columns = list(zip(*rows, strict=True)) or [()] * (7 if with_ids else 6)
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + ([pa.array(columns[6], pa.binary())] if with_ids else [])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(owners, pa.int64())), *arrays],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece"][:7 + with_ids])

    return map_batches(placed, cut, PIECES + (", piece binary" if with_ids else ""))


def sequences(pieces: DataFrame, path: str, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids``: the ids of every sequence, padded to ``window`` at the end.

    Takes pieces with ids. A sequence is at most ``window`` tokens, so its group is bounded.
    """
    size = encoder(path)[1]
    grouped = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("pieces"))

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row in batch.column("pieces").to_pylist():
            ids = np.concatenate([loaded(p["piece"], size) for p in row])
            rows.append(np.pad(ids, (0, window - len(ids)), constant_values=pad_id).tolist())
        return pa.RecordBatch.from_arrays(
            [batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    return map_batches(grouped, join, "sequence_id bigint, ids array<bigint>")

"""Plumbing shared by the text operators: Arrow batches, word hashes, tables in between."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from kerbside.session import new_table_path, pin

#: Rows and about bytes handled at a time, so that a batch's results never pile up.
SLICE_ROWS, SLICE_BYTES = 500, 4 << 20

#: Entries a worker's word cache holds before it starts anew, and the longest word it holds.
CACHE_ENTRIES, CACHED_BYTES = 100_000, 64

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One output batch for each slice of the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(f, slices(batches))

    return df.mapInArrow(run, schema)


def slices(
    batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES,
) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, none of them empty; a slice of several
    rows holds at most ``size`` bytes. At the end of a partition free memory goes back to the
    system: workers live on, and so would the largest size they have had."""
    for batch in batches:
        todo = [(0, batch.num_rows)]
        while todo:
            at, n = todo.pop()
            part = batch.slice(at, n)
            if n > rows or n > 1 and part.nbytes > size:
                half = min(rows, -(-n // 2))
                todo += [(at + half, n - half), (at, half)]
            elif n:
                yield part
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    values = batch.column(column)
    binary = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(binary).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words by lookup, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hashes(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``offsets`` from each position at which all of them exist."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        total = (total + words[o:o + n]) * (_ODD + np.uint64(2 * k + 2 * o))
        total ^= total >> np.uint64(29)
    return mix(total)


def write_table(df: DataFrame, label: str, **options: str) -> str:
    """Write a table to the shared folder; its path."""
    path = new_table_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that this package wrote to the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

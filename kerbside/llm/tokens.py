"""Token ids of whole texts with a published tokenizer, kept as one table for packing.

Each row of the table knows how many tokens its partition holds before it, so that global
offsets follow from one small sum per partition. Partition and running sums are written
with the rows; a repeated task writes them anew, consistently.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbside.llm.bpe import _byte_letters
from kerbside.llm.common import slices, write_table

#: How byte-level tokenizers of this kind cut texts. The second pattern is for
#: texts without two white-space characters in a row, where looking ahead changes nothing.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT_SINGLE_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

_TWO_SPACES = re.compile(r"\s\s")


def _ranked_vocabulary(spec: dict) -> dict[bytes, int] | None:
    """Byte strings to ids, if ids are in the order of merges over bytes cut by ``CUT``."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex")
        and not cutter.get("add_prefix_space") and not model.get("end_of_word_suffix"))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if not plain or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    letters = {c: b for b, c in _byte_letters().items()}
    return {bytes([letters[c] for c in t]): i for t, i in model["vocab"].items() if all(c in letters for c in t)}


@lru_cache(maxsize=4)
def _library(path: str) -> Tokenizer:
    """The library's own tokenizer, loaded where a text calls for it."""
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Callable[[str], np.ndarray], int]:
    """Text to ids, equal to those of the tokenizers library for this file, and the number of ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    ranks = _ranked_vocabulary(spec)

    def by_library(text: str) -> np.ndarray:
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return by_library, size
    ranks = {t: i for t, i in ranks.items() if i < 256 + len(spec["model"]["merges"])}
    whole, single = (
        tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for p in (CUT, CUT_SINGLE_SPACES))

    def by_ranks(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return by_library(text)
        return np.array((whole if _TWO_SPACES.search(text) else single)(text), np.uint32)

    return by_ranks, size


def stored(ids: np.ndarray, size: int) -> bytes:
    """Ids in the narrowest of two or four little-endian bytes that holds the vocabulary."""
    return ids.astype("<u2" if size <= 1 << 16 else "<u4").tobytes()


def loaded(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if size <= 1 << 16 else "<u4").astype("<u4")


TOKEN_SCHEMA = (
    "doc_id bigint, part int, tokens bigint, before bigint, full_before bigint, "
    "rest int, rest_rank bigint, ids binary")


def write_tokens(docs: DataFrame, path: str, end_id: int, window: int) -> str:
    """Write ``doc_id`` and the ids of ``text`` followed by ``end_id``; the table's folder.

    ``part`` numbers the writing task. ``before`` counts the tokens of earlier rows of the
    part, ``full_before`` their whole windows; ``rest`` is the row's number of tokens beyond
    whole windows and ``rest_rank`` how many earlier rows of the part have the same rest.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, size = encoder(path)
        part = TaskContext.get().partitionId()
        before = full = 0
        ranks = [0] * window
        for batch in slices(batches):
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                ids = np.append(to_ids(text) if text else np.empty(0, np.uint32), np.uint32(end_id))
                n, rest = len(ids), len(ids) % window
                rows.append((part, n, before, full, rest, ranks[rest], stored(ids, size)))
                before, full = before + n, full + n // window
                ranks[rest] += 1
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "part", "tokens", "before", "full_before", "rest", "rest_rank", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, TOKEN_SCHEMA)
    return write_table(rows, "tokens", compression="zstd")

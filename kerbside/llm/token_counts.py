"""Token counts from pre-token frequencies, without ids.

A tokenizer of this kind cuts a text into pre-tokens and merges inside each one alone, so a
document's count is the sum, over its pre-tokens, of the pieces each falls into.

1. Texts are cut in chunks of documents. A chunk is written as one row per distinct
   pre-token, with the documents of the chunk that hold it and how often: however frequent a
   pre-token is, a chunk sends it once.
2. Every distinct pre-token of the corpus is merged once, by the library's own model.
3. Pieces meet frequencies by a join on the pre-token, and are summed per document. The most
   frequent pre-tokens, a fixed number of fixed length, are joined by broadcast, so that
   their documents are summed where the chunk lies; all others by a shuffle.

Strings of special tokens are cut out first, as the library does, and count one each. Files
of the tokenizers library are supported. Where texts are cut as byte-level tokenizers do and
hold only code points on which both agree (``AGREED``), a compiled pattern cuts them; other
texts are cut by the library.

Cases: a null or empty text has no tokens. Null and repeated ids, and the same row twice,
have rows of their own. A text of any length is cut as a whole. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbside.llm.bpe import _byte_letters
from kerbside.llm.common import map_batches, slices, write_table
from kerbside.llm.tokens import CUT

#: A chunk holds at most so many documents, or about so many bytes of text.
CHUNK_ROWS, CHUNK_BYTES = 16384, 16 << 20

#: Pre-tokens joined by broadcast: so many at most, of so many bytes at most each.
FREQUENT, FREQUENT_BYTES = 1 << 16, 128

#: Pre-tokens of one text held at a time.
BLOCK = 200_000

#: Code points that the pattern's character classes and the library's place alike (tested).
AGREED = regex.compile(
    r"[\u0000-՗֐-ࢎऀ-౛ೠ-᪯Ḁ-₎℀-⿿　-꛿가-힣]*+")

FREQUENCIES = (
    "row bigint, doc_id bigint, n_bytes bigint, special bigint, "
    "token string, base bigint, docs array<int>, counts array<int>")


def narrow_cut() -> str:
    """``CUT`` for texts of code points below 256, its classes listed: no lookup per letter."""
    def listed(members: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if regex.match(members, chr(c)))

    return CUT.replace(r"[^\s\p{L}\p{N}]", f"[^{listed(r'[\s\p{L}\p{N}]')}]").replace(r"\S", f"[^{listed(r'\s')}]") \
        .replace(r"\s", f"[{listed(r'\s')}]").replace(r"\p{L}", f"[{listed(r'\p{L}')}]").replace(r"\p{N}", f"[{listed(r'\p{N}')}]")


def _narrow(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Cutter:
    """Cuts texts into pre-tokens, and a pre-token into pieces, as one tokenizer file says."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        cutter = spec.get("pre_tokenizer") or {}
        self.plain = (
            spec.get("normalizer") is None and cutter.get("type") == "ByteLevel"
            and bool(cutter.get("use_regex")) and not cutter.get("add_prefix_space"))
        odd = [t["content"] for t in spec.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd or cutter == {}:
            raise ValueError(f"{path}: special tokens that take their surroundings, or texts that are not cut, are not supported")
        contents = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self._cut, self._cut_narrow = regex.compile(CUT), re.compile(narrow_cut())
        self._letters = {b: c for b, c in _byte_letters().items()}

    def segments(self, text: str) -> tuple[list[str], int]:
        """What lies between the special tokens, and how many of them there are."""
        parts = self._special.split(text) if self._special else [text]
        return [p for p in parts if p], len(parts) - 1

    def cut(self, segment: str) -> Iterator[list[str]]:
        """The pre-tokens of a segment in lists of bounded length."""
        narrow = _narrow(segment)
        if not self.plain or not (narrow or AGREED.fullmatch(segment)):
            normal = self.library.normalizer.normalize_str(segment) if self.library.normalizer else segment
            pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
            yield [normal[a:b] for _, (a, b) in pieces] if self.plain else [p for p, _ in pieces]
            return
        pattern = self._cut_narrow if narrow else self._cut
        if len(segment) < BLOCK:
            yield pattern.findall(segment)
        else:
            found = (m.group() for m in pattern.finditer(segment))
            while block := list(islice(found, BLOCK)):
                yield block

    def pieces(self, token: str) -> int:
        if self.plain:
            token = "".join(map(self._letters.__getitem__, token.encode()))
        return len(self.library.model.tokenize(token))


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter(path)


def _chunk(texts: Iterable[str | None], cut: Cutter) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct pre-tokens of some texts, where each one's list ends, the lists' texts by
    position and counts, and the special tokens per text."""
    ids: defaultdict[str, int] = defaultdict()
    ids.default_factory = ids.__len__
    places, owners, special = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for k, text in enumerate(texts):
        segments, n = cut.segments(text) if text else ([], 0)
        special.append(n)
        counts: Counter[str] = Counter()
        for segment in segments:
            for block in cut.cut(segment):
                counts.update(block)
        places.append(np.fromiter(map(ids.__getitem__, counts), np.int64, len(counts)) << 16 | k)
        owners.append(np.fromiter(counts.values(), np.int64, len(counts)))
    keys, often = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(keys)
    keys, often = keys[order], often[order]
    return list(ids), np.searchsorted(keys >> 16, np.arange(len(ids) + 1)), keys & 0xFFFF, often, special


def write_frequencies(docs: DataFrame, path: str) -> str:
    """Write documents (``row, doc_id, n_bytes, special``) and, in rows with ``token``, which
    of the rows from ``base`` on hold a pre-token (``docs``) how often (``counts``)."""
    names = [f.split()[0] for f in FREQUENCIES.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, base = cutter(path), TaskContext.get().partitionId() << 40
        for b in slices(batches, CHUNK_ROWS, CHUNK_BYTES):
            tokens, ends, held, counts, special = _chunk(b.column("text").to_pylist(), cut)
            n, m = b.num_rows, len(tokens)
            rows = [pa.array(np.arange(base, base + n)), b.column("doc_id"), b.column("n_bytes"), pa.array(special, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows, *[pa.nulls(n, k) for k in kinds[4:]]], names)
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (held, counts)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(m, k) for k in kinds[:4]], pa.array(tokens, pa.string()), pa.array(np.full(m, base)), *lists], names)
            base += n

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return write_table(rows.mapInArrow(run, FREQUENCIES), "token-frequencies", compression="zstd")


def piece_counts(tokens: DataFrame, path: str) -> DataFrame:
    """``token, chunks, pieces`` of every distinct ``token``: each is merged once."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = cutter(path)
        pieces = [cut.pieces(t) for t in batch.column("token").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("token"), batch.column("chunks"), pa.array(pieces, pa.int64())], ["token", "chunks", "pieces"])

    return map_batches(
        tokens.groupBy("token").agg(F.count("*").alias("chunks")), run, "token string, chunks bigint, pieces bigint")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    spark = docs.sparkSession
    table = spark.read.parquet(write_frequencies(docs, path))
    found = table.filter("token is not null").select("token", "base", "docs", "counts")
    pieces = spark.read.parquet(write_table(piece_counts(found.select("token"), path), "token-pieces"))
    # At most FREQUENT rows of FREQUENT_BYTES and two numbers: some 10 MB.
    frequent = F.broadcast(pieces.filter(F.octet_length("token") <= FREQUENT_BYTES)
                           .orderBy(F.desc("chunks"), "token").limit(FREQUENT).select("token", "pieces"))
    common = found.join(frequent, "token")
    rest = found.join(frequent.select("token"), "token", "left_anti").join(pieces.select("token", "pieces"), "token")

    def per_row(joined: DataFrame) -> DataFrame:
        one = joined.select("base", "pieces", F.explode(F.arrays_zip("docs", "counts")).alias("at"))
        return one.groupBy((F.col("base") + F.col("at.docs")).alias("row")).agg(
            F.sum(F.col("at.counts") * F.col("pieces")).alias("n_tokens"))

    nothing = F.lit(None).cast("bigint")
    rows = table.filter("token is null").select("row", F.col("special").alias("n_tokens"), "doc_id", "n_bytes")
    for joined in (common, rest):
        rows = rows.unionByName(per_row(joined).withColumns({"doc_id": nothing, "n_bytes": nothing}))
    return rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"),
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: For tests of ``AGREED``: one code point in every place that decides a cut.
def probe(code_point: int) -> str:
    c = chr(code_point)
    return f"a{c}1{c}!{c} {c}{c}b"


def cuts_alike(library_cut: Callable[[str], list], code_point: int) -> bool:
    text = probe(code_point)
    return [m.span() for m in regex.finditer(CUT, text)] == [span for _, span in library_cut(text)]

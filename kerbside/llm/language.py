"""Language identification by n-gram filters with one bit per language.

Training counts, over a bounded sample of labelled documents per language, in how many
documents each letter n-gram occurs, and keeps the common ones of each language. All
languages share one Bloom filter in bit-sliced form: each slot is a mask of languages, and
the masks of an n-gram's slots, ANDed, are the languages that may hold it: one lookup for
all of them. A document's n-grams found per language are counted, corrected for the share
that the filter finds by chance, and the largest count decides.

Cases: ``und`` and 0.0 for a null or empty text, one without letters, or without any
learned language. Ties go to the language that sorts first. Repeated rows count as often as
they occur; other columns are ignored. Rows without a language or id are not learned from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.llm.common import map_batches, mix

#: Lengths of n-grams; a word's ends count as a letter.
LENGTHS = (3, 4)

#: Bounds of training: documents per language, n-grams kept per language.
SAMPLE_DOCUMENTS, SAMPLE_GRAMS = 4_000, 20_000

#: An n-gram belongs to a language if at least this share of its sampled documents hold it.
LEAST_SHARE = 0.02

#: Slots per kept n-gram and probes per lookup.
SLOTS_PER_GRAM, PROBES = 16, 3

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_hashes(text: str | None) -> np.ndarray:
    """Hashes of all letter n-grams of a text, in order, repeated as they are."""
    if not text:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[codes]
    if not letters.any():
        return np.empty(0, np.uint64)
    codes = np.where(letters, codes, 0).astype(np.uint64)
    ends = codes == 0
    codes = np.concatenate([[0], codes[~(ends & np.concatenate([[True], ends[:-1]]))], [0]]).astype(np.uint64)
    out = []
    for n in LENGTHS:
        m = len(codes) - n + 1
        if m > 0:
            inner = np.ones(m, bool)
            key = np.full(m, n, np.uint64)
            for k in range(n):
                part = codes[k:k + m]
                key = (key << np.uint64(15)) ^ (key >> np.uint64(40)) ^ part
                if 0 < k < n - 1:
                    inner &= part != 0
            out.append(key[inner])
    return mix(np.concatenate(out)) if out else np.empty(0, np.uint64)


@dataclass(frozen=True)
class LanguageFilter:
    """Languages in order, slot masks (one column per 64 languages) and chance shares."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray

    @staticmethod
    def build(grams: dict[str, np.ndarray]) -> LanguageFilter:
        languages = sorted(grams)
        total = max(1, sum(map(len, grams.values())))
        slots = 1 << int(np.ceil(np.log2(SLOTS_PER_GRAM * total)))
        masks = np.zeros((slots, -(-len(languages) // 64) or 1), np.uint64)
        for k, language in enumerate(languages):
            for slot in LanguageFilter._slots(grams[language], slots):
                masks[slot, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        filled = [(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))]
        return LanguageFilter(languages, masks, np.array(filled) ** PROBES)

    @staticmethod
    def _slots(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(p) * step) & np.uint64(slots - 1)).astype(np.int64) for p in range(PROBES)]

    def shares(self, text: str | None) -> np.ndarray | None:
        """Corrected share of the text's n-grams in each language; None without letters."""
        hashes = gram_hashes(text)
        if not len(hashes) or not self.languages:
            return None
        slots = self._slots(hashes, len(self.masks))
        found = []
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            mask = column[slots[0]]
            for s in slots[1:]:
                mask = mask & column[s]
            found += [int((mask >> np.uint64(b) & np.uint64(1)).sum()) for b in range(min(64, len(self.languages) - 64 * word))]
        raw = np.array(found) / len(hashes)
        return np.clip((raw - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        shares = self.shares(text)
        if shares is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def held_out_rows(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_DOCUMENTS, grams: int = SAMPLE_GRAMS) -> LanguageFilter:
    """Learn from ``text`` and ``lang`` of at most about ``per_language`` rows of each language,
    drawn by a hash of the id. The driver receives at most ``grams`` hashes per language."""
    rows = docs.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageFilter.build({})

    def per_lang(value: Callable[[int], float]) -> Column:
        return F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, value(n))])[F.col("lang")]

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    sample = rows.filter(place < per_lang(lambda n: min(1.0, per_language / n)))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen.setdefault(lang, []).append(np.unique(gram_hashes(text)))
        langs, grams, counts = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for lang, parts in seen.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            langs += [lang] * len(h)
            grams.append(h)
            counts.append(n)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(counts))],
            ["lang", "gram", "n"])

    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    common = (
        map_batches(sample, count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= per_lang(lambda n: max(2.0, LEAST_SHARE * min(n, per_language))))
        .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= grams))
    found: dict[str, list[int]] = {}
    for row in common.select("lang", "gram").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return LanguageFilter.build({k: np.sort(np.array(v, np.int64)).view(np.uint64) for k, v in found.items()})


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out_rows(4, 2).alias("held_out"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1] for f in found], pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageFilter, least: float) -> DataFrame:
    """The rows, all columns as they are, whose text has a known language with a share of at
    least ``least``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for text in batch.column("text").to_pylist():
            lang, score = model.predict(text)
            keep.append(lang != UNKNOWN and score >= least)
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then predict all rows."""
    return predict(docs, train(docs.filter(~held_out_rows(4, 2))))

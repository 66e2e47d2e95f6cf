"""Toxicity by FTRL-proximal logistic regression over hashed words, pairs and skip-grams.

Features of a text are its words, their beginnings (languages that compound and inflect),
neighbouring pairs and pairs with one word between, hashed into a fixed number of
coordinates. Every coordinate has its own learning rate, and an L1 term keeps most weights
at zero. A bounded sample of labelled rows is learned in shards, one task each; the shards'
weights are averaged by the gradients each has seen at a coordinate. The non-zero weights,
at most one per coordinate, are what executors receive for scoring.

Cases: a null or empty text, or one without words, scores the bias alone. Rows without id,
label or text are not learned from; several labels of one id count as toxic if one is.
Without any labelled row nothing is toxic. Repeated rows score alike; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import CACHE_ENTRIES, CACHED_BYTES, sequence_hashes, slices
from kerbside.llm.language import held_out_rows
from kerbside.sizing import broadcast_if_bounded

#: Coordinates are this many bits of a hash.
BITS = 20

#: Bound of the training sample and the number of its shards.
SAMPLE_ROWS, SHARDS = 40_000, 4

#: Beginnings of words that are features of their own, in characters.
STEMS = (3, 4, 6)

#: Rate, its smoothing, L1 and L2 of the updates; passes over a shard; the bias.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 2.0, 0.1, 3

_PUNCTUATION = ".,!?;:#*$%&|<>\"'()[]{}=+~`^@/\\-_"


class _WordKeys(dict):
    """A word to the hashes of itself and its beginnings, as bytes."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        w = word.strip(_PUNCTUATION)
        keys = [xxhash.xxh3_64_intdigest(w)] + [
            xxhash.xxh3_64_intdigest(f"{n} {w[:n]}") if len(w) >= n else 0 for n in STEMS]
        out = b"".join(k.to_bytes(8, "little") for k in keys)
        if len(word) <= CACHED_BYTES:
            self[word] = out
        return out


def features(text: str | None, keys: _WordKeys) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a text and their values: logarithms of counts, damped by length."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    table = np.frombuffer(b"".join(map(keys.__getitem__, words)), np.uint64).reshape(-1, 1 + len(STEMS))
    own = table[:, 0]
    hashes = np.concatenate([table[table != 0], sequence_hashes(own, (0, 1)), sequence_hashes(own, (0, 2))])
    coordinates, counts = np.unique(hashes >> np.uint64(64 - BITS), return_counts=True)
    return coordinates.astype(np.int64), np.log2(1 + counts) / np.log2(2 + len(words) / 100)


class Ftrl:
    """Weights by follow-the-regularised-leader; the bias is the coordinate behind the last."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = at == 1 << BITS
        strength = np.where(free, 0.0, L1)
        return np.where(np.abs(z) <= strength, 0.0, -(z - np.sign(z) * strength) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
        w = self.weights(at)
        gradient = (_sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient * gradient


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -35.0), 35.0)))


@dataclass(frozen=True)
class ToxicityModel:
    """Sparse weights by coordinate, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.at] = self.weight
        return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn ``labels.toxic`` from about ``sample_rows`` rows at most, drawn by a hash of the id."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null") \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share * 1e6)
    rows = docs.select("doc_id", "text").filter("text is not null").join(
        broadcast_if_bounded(drawn.withColumn("doc_id", F.col("doc_id").cast("bigint")), 2 * sample_rows), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, model = _WordKeys(), Ftrl()
        seen = sorted((xxhash.xxh3_64_intdigest(f"{i} {t}"), t, y) for b in batches for i, t, y in zip(
            *(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
        for _ in range(PASSES):
            for _, text, label in seen:
                model.learn(*features(text, keys), label)
        at = np.flatnonzero(model.n)
        w = model.weights(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(w), pa.array(model.n[at])], ["at", "w", "n"])

    shards = rows.repartition(SHARDS, F.xxhash64("doc_id", F.lit(6)))
    merged = shards.mapInArrow(learn, "at bigint, w double, n double").groupBy("at").agg(
        (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).filter("w != 0").collect()
    at = np.array([r["at"] for r in merged], np.int64)
    w = np.array([r["w"] for r in merged])
    order = np.argsort(at)
    at, w = at[order], w[order]
    bias = w[at == 1 << BITS]
    return ToxicityModel(at[at < 1 << BITS], w[at < 1 << BITS], float(bias[0]) if len(bias) else -np.inf)


def _scores(texts: list[str | None], dense: np.ndarray, bias: float, keys: _WordKeys) -> list[float]:
    out = []
    for text in texts:
        at, x = features(text, keys)
        out.append(_sigmoid(float(dense[at] @ x) + bias))
    return out


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out_rows(5, 0).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dense = _WordKeys(), model.dense()
        for b in slices(batches):
            scores = _scores(b.column("text").to_pylist(), dense, model.bias, keys)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: ToxicityModel, below: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, that score less than ``below``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dense = _WordKeys(), model.dense()
        for b in slices(batches):
            scores = _scores(b.column("text").to_pylist(), dense, model.bias, keys)
            yield b.filter(pa.array([s < below for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then score all rows."""
    return score(docs, train(docs.filter(~held_out_rows(5, 0)), labels))

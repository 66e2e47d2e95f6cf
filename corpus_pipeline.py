"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows that the one before kept and returns the columns of
``documents``; the last one returns pieces of packed sequences. Models are learned from the
rows a stage receives.

Cases: null and empty texts, and those without a letter, go at the first stage. Null and
repeated ids are rows like others: of rows that are near-duplicates one stays, whatever its id.
Texts of any length are handled whole. An empty table gives no pieces. Further columns pass
through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kerbside.llm import language, ngram_join, packing, secrets, toxicity
from kerbside.llm.common import table, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose best language holds a smaller share of their n-grams are rejected.
LEAST_LANGUAGE_SHARE = 0.15


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those that are in none of the learned languages."""
    model = language.train(docs.filter(~language.held_out_rows(4, 2)))
    return language.keep_known(docs, model, LEAST_LANGUAGE_SHARE)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are predicted toxic."""
    model = toxicity.train(docs.filter(~language.held_out_rows(5, 0)), table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates: documents that
    share 80 % of their shingles of five words, or are linked by such ones."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document goes."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Trained models and tokenizers decide rows, which SQL cannot state.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spark.read.parquet(write_table(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus in five stages, each one operator of prosegauge.llm over all rows that its predecessor kept.

1. language_id: documents in no language go (no letter, or most words are like noise to a field that learned noise beside the
   languages of lang; a document labelled with a language of which the field saw too little stays).
2. ngram_jaccard_join: one document of each class of near copies stays, that of the smallest id.
3. decontaminate: documents that hold a window of a benchmark item go.
4. personal_data: every span is masked in the text; n_chars follows; no document goes.
5. mix: each document's share of the token budget of its source (size, source_size, target, taken).

Stages 1 to 4 return the columns of documents. Nulls, empty and very long texts, repeated rows, empty tables and extra
columns are handled as the operators' docstrings say."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosegauge.llm import decontam, langid, mixing, neardup, pii
from prosegauge.llm.common import table
from prosegauge.sources.tables import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.reject(docs, langid.train(langid.training_rows(docs), noise=True))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: The language field, the MinHash forest and the personal-data field have no SQL form; tests/llm holds the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

"""Corpus pipeline: stages that each apply one training-data operator to what the previous one kept.

Every stage gets the documents that the stage before has written, works on all of them, and returns
the same columns; the last one returns token ids as digests.

1. toxicity: documents that the classifier chain rejects go. Labels come from the labels table.
2. near duplicates: five-word shingles, similarity 0.8; of each group the document with the smallest id stays.
3. decontamination: passages of ten words or more shared with a benchmark item, and whole shorter items,
   are cut out; a document that is mostly such passages goes.
4. secrets: credentials are replaced by a mark; all documents stay.
5. byte-pair encoding: token ids of every text, decoded again as a check.

Null, empty and very long texts, repeated rows, empty tables and extra columns are handled as each operator's
module says; without labels nothing is rejected, without benchmark items nothing is cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, decontam, dedup, secrets, toxicity
from ledgerlens.llm.queries import WORD_VOCABULARY, digests, table
from ledgerlens.llm.stored import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates_removed(docs, words=5, percent=80)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", cut_benchmark_passages),
    ("secrets", redact_secrets), ("bpe", encode),
]

#: No stage but the last could be said in SQL; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

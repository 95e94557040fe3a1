"""From raw documents to encoded training text, in five stages that are each written and read again.

A document goes if its text is null, has no letters or is in none of the learned languages, if a document of a lesser id is
in its group of near copies, or if its text holds a benchmark window; all others stay, empty columns, ties in languages and
further columns included. Rows that repeat one doc_id are rows like others and stay or go together, but for those of one
group, whose least id stays with all its rows. Without documents every stage is empty; without labelled ones no language
is learned and nothing stays. The last stage returns doc_id, n_tokens, the token ids (little-endian unsigned 32-bit) and the
digests of the ids and of the decoded text. A stage's folder goes when the next one is written; the last one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, decontaminate, jaccard, langid, pii
from loomgraph.llm.common import drop, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; ``und`` and texts like none of them go."""
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of five-word shingle sets at a Jaccard similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, width=5, threshold=(80, 100))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of ten words (or a whole shorter item)."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(docs), keep_ids=True)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("personal_data", without_personal_data),
    ("bpe_codec", encoded),
]

#: Language identification, near-duplicate components and the codec have no SQL; brute force tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs

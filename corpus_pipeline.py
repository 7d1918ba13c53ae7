"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents, with the rows that it keeps: texts that do not score as toxic, that
every quality rule keeps, one of each group of exact or near copies, and those without a benchmark passage. The last encodes."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from playbill.llm import byte_bpe, decontaminate, quality_cascade, simhash_trie, toxicity_labels
from playbill.llm.common import read, written
from playbill.llm.queries import VOCABULARY

#: SQL cannot express the learned and the linked stages; tests compare them with brute force.
ORACLE_SQL = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model is fitted on these documents and the labels."""
    return toxicity_labels.clean_only(docs, read(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule of the cascade keeps."""
    return quality_cascade.kept(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, for each group of exact and near copies."""
    return simhash_trie.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    return byte_bpe.digest(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", not_toxic),
    ("quality rules", of_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

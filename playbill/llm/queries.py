"""One query per operator, over the whole tables, and the DuckDB equivalents of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from playbill.llm import (
    byte_bpe, chat_schema, decontaminate, license_rules, merkle_dag, quality_cascade, revisits, shard_slots, simhash_trie, token_files, toxicity_labels, vector_codes, wrapper,
)
from playbill.llm.common import read
from playbill.llm.oracles import ORACLES  # noqa: F401
from playbill.session import new_run_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def op1_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots.digest(read(spark, sf_dir, "documents"), new_run_dir(spark, "slot-map"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.digest(read(spark, sf_dir, "documents"))


def op3_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.digest(read(spark, sf_dir, "pages"))


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.digest(read(spark, sf_dir, "documents"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.digest(read(spark, sf_dir, "documents"))


def op6_chat_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_schema.digest(read(spark, sf_dir, "conversations"))


def op7_toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_labels.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.digest(read(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(read(spark, sf_dir, "embeddings"))


def op12_merkle_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_dag.digest(read(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), new_run_dir(spark, "token-ids"))


QUERIES = {f.__name__: f for f in (
    op1_shard_slots, op2_license_rules, op3_wrapper, op4_simhash_trie, op5_quality_cascade, op6_chat_schema, op7_toxicity_labels, op8_decontaminate, op9_byte_bpe, op10_revisits,
    op11_vector_codes, op12_merkle_dag, op13_token_files)}

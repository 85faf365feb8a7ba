"""A corpus pipeline of five stages, each an operator of the library; see STAGES.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import bpe, decontaminate, secrets, simhash, toxicity
from locusframe.llm._common import checkpointed, table


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.reject_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their 5-word shingles at least) stays, that of the smallest id."""
    return simhash.deduplicate(docs, find=simhash.near_copies)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and digests of them and of the text that they decode to."""
    return bpe.tokenize(docs, columns=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", clean_speech), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", no_secrets), ("tokens", tokens)]

#: Hashing, learned scores and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpointed(docs) if k else docs, sf_dir)  # else later stages would work the earlier ones out again
    return docs

"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from girder.llm import decontaminate, mixing, quality, simhash, token_output
from girder.llm.common import fresh_path, staged
from girder.llm.queries import table, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the text rules or leave their language's perplexity band go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one of the least id."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled with probabilities raked to source, language and topic targets."""
    return mixing.sample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards are written and read back: where each document's ids are, and their checksum."""
    folder = fresh_path(spark, "tokens")
    manifest = staged(token_output.write_tokens(docs, folder, tokenizer_file(), plain_special=False), "manifest")
    return token_output.read_tokens(spark, folder, manifest)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
    ("token_output", token_ids),
]

#: Perplexity bands, link components and tokenizing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

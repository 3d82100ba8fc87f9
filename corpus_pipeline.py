"""A corpus pipeline of five stages: language ID, exact dedup, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir); its result is written to the shared folder as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ratewise.llm import common, exact_dedup, jaccard, langid, mixing, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, or without a letter) go; the others have a language from here on, predicted where the label is null."""
    return langid.with_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links tie together, the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times; sources above their target lose documents."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, each piece with its document's language and source; a document that the mix repeats is packed as often."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), keep=("lang", "source"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_duplicates", near), ("mix", mix), ("pack", pack)]
#: No SQL: language models, mixing and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

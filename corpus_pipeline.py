"""From raw documents to token ids: language ID, exact dedup, near dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagforge.llm import bpe_words, exact_dedup, jaccard_join, lang_id, mixing
from tagforge.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has letters and is near to a language that the labelled ones teach, or too short to tell."""
    return lang_id.accepted(docs, lang_id.train(docs.where(~lang_id.held_out()).select("doc_id", "text", "lang")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays: the longest, then the smallest doc_id."""
    return exact_dedup.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at 0.8, the smallest doc_id of each group stays."""
    return jaccard_join.survivors(docs, k=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mixed_rows(docs, mixing.label_quality(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix."""
    return bpe_words.digests(docs, bpe_words.default_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies), ("mixing", mix), ("bpe", encode)]

#: Language profiles and the library's merges are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing sources, BPE encoding.

Each stage works on all rows that the one before it kept, and its result is written as Parquet and
read again. Nulls, blank and very long texts, ties, repeated rows, empty tables and columns with
clashing names have the results that the operators' modules define; in short: a text without letters
goes in the first stage, and no stage reads columns other than doc_id, text, source and lang.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyboard.llm import bpe, exact_dedup, lang_id, mixing, ngram_join
from tallyboard.llm.common import bound_batches, read_table, saved
from tallyboard.llm.queries import language_model

#: Least share of a text's letters in its main language.
MAIN_LANGUAGE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those with no main language."""
    bound_batches(spark)
    return lang_id.keep_identified(docs, language_model(docs), MAIN_LANGUAGE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the smallest doc_id's."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the smallest doc_id's."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target asks."""
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text of each row."""
    bound_batches(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: Language ID and BPE are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs

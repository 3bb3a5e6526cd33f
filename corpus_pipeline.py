"""From raw documents to a tokenised training mixture, in five stages.

Each stage reads what the one before it kept, from Parquet. All but the last
return the columns of documents, extra ones included, whatever their names.

Odd rows: a null or empty text is a text without words. The classifier judges it as
such; if it is kept, it is no near copy, has no passage, stays in the mixture at
least once and has no tokens. Rows without an id are judged, never dropped as copies
or cut, and mixed like others; rows that share an id are one document to the Jaccard
join, which keeps one of them if their texts have words, and to the passages. Ties go
to the smallest id. Texts of any length are read whole. Empty tables give empty ones;
without labels every document passes the classifier.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, mixing, ordinal, signature_tree, suffix_array
from tallyloom.store import keep, scratch, store
from tallyloom.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 or better is at least one half; null texts are judged as texts without words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ordinal.keep_quality(docs, labels.select("doc_id", ordinal.graded().alias("grade")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of 5-word shingles of at least 0.8. Rows without an id, a text or words stay."""
    return signature_tree.one_of_each(docs, Fraction(80, 100), 5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them; rows without an id and null texts don't change."""
    return suffix_array.without_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeated, twice at most; every row stays once at least, null sources are one source."""
    return mixing.mix_documents(docs, repetition_limit=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the texts decoded from them, for every row; a null text is the empty one."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encoded(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Four of the stages can't be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_words, ids_sha256, decoded_sha256 of every row that the five stages leave of documents, as often as it is in the mixture.

    What a stage returns is written to the shared folder and read from there by the next.
    """
    docs = ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch():  # what a stage stores on its way goes once its result is written
            made = keep(store(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if before:
            before.drop()
        docs, before = made.df, made
    return docs

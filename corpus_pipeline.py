"""Corpus pipeline: five stages over documents, each of which reads all that the one before kept.

Toxic documents go; of near copies (five-word shingles, Jaccard 0.8 or more) the smallest id stays; passages
of over 50 words, or of 400 bytes, that still repeat are cut out; the rest is sampled to the target mix; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, pieces, suffix_dedup, toxicity
from tessera.llm.common import new_path, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; it learns from the labels of the documents given."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; rows with a null id stay."""
    return ngram_join.representatives(docs, width=5, num=4, den=5)


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat; n_chars is counted again."""
    return suffix_dedup.without_repeats(docs, words=suffix_dedup.WORDS).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of up to three quarters of the tokens with the target shares of sources, languages and topics as far as there are texts."""
    return mixing.mixed(docs, budget=mixing.BUDGET)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text in the place of the text."""
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("repeated_passages", repeated_passages_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]
ORACLE_SQL = None  # the first stage is a trained model and the last a tokenizer; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each is written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

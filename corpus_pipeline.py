"""From raw documents to packed training sequences.

Five stages: documents of low quality go, toxic documents go, of near copies one stays, sources are mixed to equal shares by
replication, and what is left is packed into sequences of 1024 tokens. Each stage reads what the one before wrote.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import jaccard, mixing, packing, quality, scratch, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged; its labels teach as in the query op3."""
    rated = quality.scored(docs, _labels(spark, sf_dir), keep=docs.columns)
    return rated.where(F.col(quality.SCORE) >= quality.THRESHOLD).drop(quality.SCORE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not mark, unchanged."""
    rated = toxicity.scored(docs, _labels(spark, sf_dir), keep=docs.columns)
    return rated.where(F.col(toxicity.SCORE) < toxicity.THRESHOLD).drop(toxicity.SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, likeness 0.8 or more."""
    return jaccard.distinct(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source with the same share of the bytes, by Poisson replication, shuffled. A document may come back several times or not at all."""
    return mixing.mix(docs, weights=None, by="source", seed=10).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifiers and the packing are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents: the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch.passing() as keep:
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{number}")
            keep.add(docs._touchline_path)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

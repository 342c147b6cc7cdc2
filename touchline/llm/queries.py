"""The registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from touchline.llm import fingerprints, interpolation, jaccard, mixing, packing, pivots, quality, sharding, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under Zipf scores of the file's pieces, as it holds merge ranks and no probabilities: not the counts of its own merges."""
    return token_counts.count(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(_table(spark, sf_dir, "documents"), folds=10)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=16)


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), by="source", seed=10)


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_mixing_sources": op10_mixing_sources,
}

_REACH = """
reach as (select a as id, b as other from links union select r.id, l.b from reach r join links l on l.a = r.other),
component as (select id, least(id, min(other)) as component_id from reach group by id)
"""

#: By all pairs, for tables on which that can be run.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
entries as (select doc_id, len(s) as n, unnest(s) as token from sets),
links as (select x.doc_id as a, y.doc_id as b from entries x join entries y on x.token = y.token and x.doc_id <> y.doc_id where 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
"""
    + _REACH
    + "select s.doc_id, len(s.s) as n_shingles, coalesce(c.component_id, s.doc_id) as component_id from sets s left join component c on c.id = s.doc_id",
    "op8_embedding_near_dedup": """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
"""
    + _REACH
    + ", n as (select a, count(*) as n from links group by a) select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.component_id, e.vec_id) as component_id, coalesce(c.component_id, e.vec_id) = e.vec_id as kept from embeddings e left join n on n.a = e.vec_id left join component c on c.id = e.vec_id",
}

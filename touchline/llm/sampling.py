"""Labelled documents to learn from: a bounded, hashed sample of the label table, then the documents it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, held: Column, most: int, seed: str) -> DataFrame:
    """(doc_id, text, label) of at most `most` documents of either label, chosen by hash among those not held out.

    Labels other than 0 and 1 and null ids teach nothing; of repeated label rows the largest counts, of several texts under one id the least.
    `most` bounds what is broadcast, 2 * most ids, and how many texts come back.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = [rows.where(F.col("label") == x).orderBy(place, "doc_id").limit(most) for x in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

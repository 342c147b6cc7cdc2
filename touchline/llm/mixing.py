"""Mixing sources to target weights by Poisson replication.

A source whose documents should be read r times on average gives each of its documents a count drawn from the Poisson
distribution with mean r: the distribution is inverted at a uniform number hashed from the seed and the document, so a run
gives the same copies again. The document is exploded by its count and all copies are shuffled by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import scratch

#: A mean over this is drawn as a sum of equal Poisson numbers below it, each from its own hash: exact, and tables stay short.
LARGEST_MEAN = 8.0
#: The largest sources, up to this number, are joined by broadcast; of the others none has more than this part of the bytes.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    """53 hashed bits as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _cumulative(mean: Column) -> Column:
    """P(count <= k) for k from 0 to where a double no longer tells it from 1, for a mean up to LARGEST_MEAN."""
    terms = next(k for k in range(1, 200) if math.exp(-LARGEST_MEAN) * LARGEST_MEAN**k / math.factorial(k) < 2.0**-56 and k > LARGEST_MEAN)

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        total = state["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(state["sums"], F.array(total)).alias("sums"))

    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("sums"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: k.cast("double")), start, step, lambda s: s["sums"])


def rates(docs: DataFrame, weights: dict[str, float] | None, by: str, total: int | None) -> DataFrame:
    """(source, size, rate, parts, cumulative): how often each source's documents are to be read on average.

    A source's share of the mix is its weight over the weights' sum, in bytes of text plus one a document; weights None gives each
    source the same. The mix has `total` such bytes, None as many as the sources in the mix have. Sources without a weight get 0.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1).cast("long")
    sizes = scratch.table(docs.groupBy(F.col(by).alias("source")).agg(F.sum(size).alias("size")), "sources")  # read below more than once
    weight = F.lit(1.0)
    if weights is not None:
        table = docs.sparkSession.createDataFrame([*weights.items()] or [(None, 0.0)], "weighted string, weight double")  # what the caller gave
        sizes = sizes.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("weighted")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sizes = sizes.withColumn("weight", weight)
    all_weight, all_size = sizes.where("weight > 0").agg(F.sum("weight"), F.sum("size")).first()
    goal = total if total is not None else all_size or 0
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.lit(all_weight or 1.0) * F.lit(float(goal)) / F.col("size")).otherwise(F.lit(0.0))
    sizes = sizes.select("source", "size", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int"))
    return sizes.withColumn("cumulative", _cumulative(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, by: str = "source", total: int | None = None, seed: int = 0) -> DataFrame:
    """docs' columns and `copy` (from 1; `touchline_copy` if docs have a copy of their own): each document as often as its source's rate drew, all in hashed order.

    docs needs doc_id, text and the column `by` (a null is a source of its own). Documents are told apart by doc_id and text: repeated rows draw
    the same count each. A null text has no bytes but the one each document has. An empty table, or no positive weight, gives no
    rows. Output partitions are parts of one random order: each row's place depends on the seed and the row alone. Columns may have any names
    but ones that begin with `_mix_`.
    """
    found = rates(docs, weights, by, total).select(F.col("source").alias("_mix_source"), "size", F.struct("parts", "cumulative").alias("_mix_table"))
    table = F.col("_mix_table")
    own = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("_mix_key", F.xxhash64(F.lit(seed), F.col("doc_id"), own))
    same = F.col(by).eqNullSafe(F.col("_mix_source"))
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(found.drop("size")), same)
    else:
        # A large source never meets its rate in one task: only the rows of the others are dealt by source.
        large = found.orderBy(F.col("size").desc(), "_mix_source").limit(BROADCAST_SOURCES).drop("size")
        names = large.select("_mix_source")
        others = found.drop("size").join(F.broadcast(names.withColumnRenamed("_mix_source", "_mix_large")), F.col("_mix_source").eqNullSafe(F.col("_mix_large")), "left_anti")
        joined = keyed.join(F.broadcast(large), same).unionByName(keyed.join(F.broadcast(names), same, "left_anti").join(others, same))
    uniforms = F.transform(F.sequence(F.lit(1), table["parts"]), lambda part: _uniform(F.col("_mix_key"), F.lit("count"), part))
    drawn = F.aggregate(uniforms, F.lit(0), lambda n, u: n + F.size(F.filter(table["cumulative"], lambda c: c <= u)))
    copies = joined.withColumn("_mix_count", drawn).where("_mix_count > 0")
    name = "touchline_copy" if "copy" in map(str.lower, docs.columns) else "copy"
    copies = copies.select(*(F.col(f"`{c}`") for c in docs.columns), "_mix_key", F.explode(F.sequence(F.lit(1), F.col("_mix_count"))).alias(name))
    copies = copies.withColumn("_mix_place", F.xxhash64("_mix_key", F.lit("place"), name))
    return copies.repartition(F.col("_mix_place")).sortWithinPartitions("_mix_place").drop("_mix_key", "_mix_place")

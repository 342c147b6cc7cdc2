"""Null and repeated ids, draws worked again, likeness of known edits, many sources."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from touchline.llm import fingerprints, interpolation, mixing, packing, pivots, quality, sharding, toxicity

DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Several rows without an id, rows that come twice, one id with two texts, one very long text."""
    rows = [(None, "no id at all", "a"), (None, "no id at all", "a"), (None, None, None), (1, "one text here", "a"), (1, "one text here", "a"), (1, "another text", "b"), (2, "", "b"), (3, None, "b"), (4, "long words " * 30_000, "a"), (5, "plain words", "c")]
    return spark.createDataFrame(rows, DOCS)


def test_rows_without_an_id_stay(odd):
    ids = Counter(r.doc_id for r in odd.collect())
    results = {
        "op1": fingerprints.fingerprints(odd),
        "op6": interpolation.score(odd),
        "op9": sharding.shard(odd),
        "op2": toxicity.classify(odd, odd.selectExpr("doc_id", "1 as toxic", "1 as quality").where("false")),
        "op3": quality.classify(odd, odd.selectExpr("doc_id", "1 as toxic", "1 as quality").where("false")),
    }
    for name, found in results.items():
        assert Counter(r.doc_id for r in found.collect()) == ids, name
    packed = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == ids
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    copies = mixing.mix(odd, total=10**7).collect()
    assert {(r.doc_id, r.text, r.source) for r in copies} == {tuple(r) for r in odd.collect()}


def test_draws_are_the_inverse_at_the_hashed_uniform(spark):
    """Counts worked from the document's hash by the textbook's inversion."""
    docs = spark.range(600).selectExpr("id as doc_id", "concat('t', id) as text", "if(id % 5 = 0, 'x', 'y') as source")
    found = Counter(r.doc_id for r in mixing.mix(docs, {"x": 5.0, "y": 1.0}, total=16_000, seed=3).collect())
    rate = {r.source: (r.rate, r.parts) for r in mixing.rates(docs, {"x": 5.0, "y": 1.0}, "source", 16_000).collect()}
    assert rate["x"][1] > 1  # drawn in parts
    hashed = docs.withColumn("key", F.xxhash64(F.lit(3), "doc_id", "text"))
    for r in hashed.select("doc_id", "source", *(F.shiftrightunsigned(F.xxhash64("key", F.lit("count"), F.lit(p)), 11).alias(f"u{p}") for p in range(1, 10))).collect():
        mean, parts = rate[r.source]
        drawn = 0
        for p in range(1, parts + 1):
            u, k, term = r[f"u{p}"] * 2.0**-53, 0, np.exp(-mean / parts)
            total = term
            while total <= u:
                k += 1
                term *= mean / parts / k
                total += term
            drawn += k
        assert found[r.doc_id] == drawn


def test_mixing_of_more_sources_than_are_broadcast(spark, monkeypatch):
    docs = spark.range(900).selectExpr("id as doc_id", "repeat('t', int(id % 40)) as text", "if(id < 500, 'hot', if(id % 7 = 0, null, concat('s', id % 11))) as source")
    want = Counter((r.doc_id, r.source, r.copy) for r in mixing.mix(docs, total=90_000, seed=2).collect())
    for most in (1, 3):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        assert Counter((r.doc_id, r.source, r.copy) for r in mixing.mix(docs, total=90_000, seed=2).collect()) == want


def test_likeness_of_known_edits(spark):
    """Half of a text replaced by another: 0.5 on average; other texts: near none; the same text: 1."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choice(words, 200))) for i in range(60)]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert abs(np.mean([r.near_edited for r in found]) - 0.5) < 0.08
    assert np.mean([r.near_next for r in found]) < 0.1
    same = fingerprints.fingerprints(spark.createDataFrame([(i, rows[0][1]) for i in range(3)], "doc_id long, text string")).collect()
    assert all(r.near_next == 1 for r in same)


def test_vectors_with_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(None, v, 1), (None, w, 1), (3, v, 1), (3, v, 1), (4, v, 1), (5, w, 1), (6, v, 2)]
    found = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit(9))).collect()
    assert len(found) == len(rows)
    own = {r.vec_id: r for r in found if r.vec_id is not None}
    assert own[4].component_id == own[3].component_id == 3 and own[6].component_id == 6 and own[6].n_links == 0
    assert own[3].kept and not own[4].kept

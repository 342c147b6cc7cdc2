"""Where intermediate tables go, and when they go."""

import pathlib

import numpy as np
import pytest

from touchline.llm import memory, ordering, pivots, quality, sampling, scratch


class Elsewhere:
    """A session of a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.root(Elsewhere)


def test_a_written_table_gives_the_drivers_memory_back(spark, monkeypatch):
    said = []
    monkeypatch.setattr(memory, "relieve", lambda s, f=memory.relieve: said.append(f(s)))
    scratch.drop(scratch.table(spark.range(3), "first"))
    assert len(said) == 1 and "rim native heap" in said[0]


def test_passing_tables_go(spark):
    first = scratch.table(spark.range(3), "first")
    with scratch.passing() as keep:
        second = scratch.table(first, "second")
        third = scratch.table(second, "third")
        keep.add(third._touchline_path)
    exists = lambda df: pathlib.Path(df._touchline_path.removeprefix("file://")).exists()
    assert (exists(first), exists(second), exists(third)) == (True, False, True) and third.count() == 3
    scratch.drop(first)
    scratch.drop(third)


def test_ranges(spark):
    rows = spark.range(50_000).selectExpr("if(id % 3 = 0, 7, id) as id")
    cuts = ordering.bounds(rows, "id", 1000)
    sizes = [r["count"] for r in rows.groupBy(ordering.range_of("id", cuts).alias("r")).count().collect()]
    assert cuts == sorted(set(cuts)) and 30 <= len(cuts) <= 50 and sorted(sizes)[-2] < 2500
    assert ordering.bounds(spark.createDataFrame([(None,)] * 3000, "id long"), "id", 1000) == []


def test_one_text_of_an_id_is_learned_from(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    got = sampling.labelled(docs, labels, "toxic", sampling.remainder("doc_id", 3) == 9, 10, "s").collect()
    assert sorted((r.doc_id, r.label, r.text) for r in got) == [(1, 1, "a"), (2, 0, "")]


def test_an_empty_text_has_no_features():
    assert quality.features(b"") == [0.0] * len(quality.FEATURES)
    assert quality.features(b"word")[quality.FEATURES.index("repeated_pairs")] == 0.0


def test_vectors_near_a_common_mean(spark):
    """All cosines are above 0.7: the pivots must still tell the groups apart."""
    rng = np.random.default_rng(5)
    mean = rng.normal(size=32) * 2
    centres = mean + rng.normal(size=(150, 32))
    rows = [(i, (centres[i % 150] + rng.normal(size=32) * rng.choice([0.02, 0.15])).tolist(), 1) for i in range(1200)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = x @ x.T
    links = (cosines >= 0.98) & ~np.eye(len(x), dtype=bool)
    assert np.quantile(cosines, 0.05) > 0.6 and len(pivots._spread(x, 64)) >= 32
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98).collect()}
    assert all(got[i] <= links[i].sum() for i in got) and sum(got.values()) >= 0.9 * links.sum()

"""Rules of association, licences, the stage registry, and the entry without the corpus operators."""

import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from touchline.operators import association as A
from touchline.operators import governance as Q

EVIDENCE = "clip long, tracklet_id long, start long, end long, team long, anchor string, embedding array<double>, entry_x double, entry_y double, exit_x double, exit_y double"


def tracklet(i, start, end, embedding=(1.0, 0.0), team=0, anchor=None, entry=(None, None), exit=(None, None)):
    return (1, i, start, end, team, anchor, None if embedding is None else list(embedding), *entry, *exit)


def threads(spark, *rows, **k):
    return {r.tracklet_id: r.thread_id for r in A.two_pass_threads(spark.createDataFrame(list(rows), EVIDENCE), **k).collect()}


def test_threads_respect_time_team_anchor_and_speed(spark):
    got = threads(
        spark, tracklet(1, 0, 10), tracklet(2, 20, 30), tracklet(3, 25, 35), tracklet(4, 40, 50, team=1), tracklet(5, 60, 70, (0.0, 1.0), anchor="a"), tracklet(6, 80, 90, (1.0, 0.0), anchor="a"), tracklet(7, 100, 110, None)
    )
    assert got[2] == 1 or got[3] == 1
    assert got[2] != got[3] and got[4] == 4 and got[6] == got[5] and got[7] == 7
    fast = threads(spark, tracklet(1, 0, 10, entry=(0.0, 0.0), exit=(0.0, 0.0)), tracklet(2, 12, 30, entry=(1.0, 1.0), exit=(1.0, 1.0)))
    assert fast == {1: 1, 2: 2}


def test_second_pass_joins_threads(spark):
    rows = [tracklet(1, 0, 10, (1.0, 0.0)), tracklet(2, 20, 30, (0.6, 0.8)), tracklet(3, 40, 50, (1.0, 0.1))]
    assert threads(spark, *rows, least=3.5, second=None)[3] == 1
    assert threads(spark, *rows, least=5.0, second=None) == {1: 1, 2: 2, 3: 3}
    assert threads(spark, *rows, least=5.0, second=3.5)[3] == 1


def test_part_similarity_is_null_without_shared_parts(spark):
    rows = [(1, 1, 0, [[1.0, 0.0], [1.0, 0.0]], [1.0, 0.0]), (1, 2, 0, [[0.0, 1.0], [1.0, 0.0]], [0.5, 1.0]), (1, 3, 0, [[1.0, 0.0], [1.0, 0.0]], [0.0, 1.0])]
    reps = A.representations(spark.createDataFrame(rows, "clip long, tracklet_id long, frame long, parts array<array<double>>, visibility array<double>"))
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 3)], "clip long, a long, b long")
    got = {(r.a, r.b): r.score for r in A.part_similarity(pairs, reps).collect()}
    assert got == {(1, 2): pytest.approx(0), (2, 3): pytest.approx(1)}


def test_representations_are_capped_and_by_quality(spark):
    frames = [(1, 1, f, [[math.cos(f), math.sin(f)]], [1.0]) for f in range(8)] + [(1, 1, 9, [[0.0, 0.0]], [1.0])]
    got = A.representations(spark.createDataFrame(frames, "clip long, tracklet_id long, frame long, parts array<array<double>>, visibility array<double>"), most=3).collect()
    assert len(got) == 3 and sum(r.n_frames for r in got) == 8


def test_reranking_keeps_missing_pairs_missing(spark):
    rows = [(1, 1, 2, 0.9), (1, 1, 3, 0.8), (1, 2, 3, 0.85), (1, 3, 4, 0.1)]
    got = {(r.a, r.b): r.score for r in A.reranked(spark.createDataFrame(rows, "clip long, a long, b long, score double")).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3), (3, 4)} and got[1, 2] > got[3, 4]


def test_fusion_weights_prefer_the_telling_channel(spark):
    rows = [(e, c == 0, (1.0 if c == 0 else 0.0) + 0.3 * ((e * 7 + c * 3) % 5), ((e * 11 + c * 5) % 7) / 7) for e in range(40) for c in range(4)]
    got = A.fusion_weights(spark.createDataFrame(rows, "episode long, correct boolean, good double, noise double"), ["good", "noise"])
    assert got["good"] > abs(got["noise"])
    assert A.fusion_weights(spark.createDataFrame([(1, False, 1.0)], "episode long, correct boolean, good double"), ["good"]) == {"good": 1.0}


def test_frontier_and_hull(spark):
    rows = [(1, 0.9, True), (1, 0.8, False), (2, 0.7, False), (2, 0.6, True), (3, 0.5, True)]
    got = A.frontier(spark.createDataFrame(rows, "episode long, score double, correct boolean")).orderBy(F.desc("threshold")).collect()
    assert [(r.correct, r.wrong) for r in got] == [(1, 0), (1, 1), (2, 1)]
    top = A.hull(A.frontier(spark.createDataFrame(rows, "episode long, score double, correct boolean"))).orderBy("coverage").collect()
    assert [round(r.precision, 3) for r in top] == [1.0, 0.667]


def test_merge_quality(spark):
    threads_ = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 1)], "clip long, tracklet_id long, thread_id long")
    composition = spark.createDataFrame([(1, 1, 7, 10), (1, 2, 7, 10), (1, 3, 7, 10), (1, 4, 8, 2)], "clip long, tracklet_id long, gt_id long, n long")
    r = A.merge_quality(threads_, composition).first()
    assert (r.n_pairs, r.n_pairs_correct, r.n_missed_pairs, r.merge_precision, r.merge_recall) == (3, 1, 2, 0.3333, 0.3333)


def test_frame_exits_look_at_the_border(spark):
    boxes = spark.createDataFrame([(1, 1, f, 0.0 if f in (5, 20) else 200.0, 100.0, 10.0, 10.0) for f in (*range(6), *range(20, 25))] + [(1, 2, f, 200.0, 100.0, 10.0, 10.0) for f in (0, 1, 20)], "clip long, gt_id long, frame long, x double, y double, w double, h double")
    switches = spark.createDataFrame([(1, 1, 0, 24), (1, 2, 0, 24), (1, 3, 0, 9)], "clip long, gt_id long, from_frame long, to_frame long")
    assert {r.gt_id: r.is_exit for r in A.frame_exits(switches, boxes, 400.0, 400.0).collect()} == {1: True, 2: False, 3: False}


def test_anchors_cover_a_share(spark):
    rows = spark.createDataFrame([(1, i, f"n{i % 4}" if i < 20 else None) for i in range(30)], "clip long, tracklet_id long, name string")
    got = A.oracle_anchors(rows, 0.5, 0.0).collect()
    assert len(got) == 10 and all(r.candidate == f"n{r.tracklet_id % 4}" for r in got) and got[0].log_lr == pytest.approx(math.log(999))


def test_licences_fail_closed(spark):
    values = ["MIT", "AGPL-3.0", "", None, "unknown", "Custom", "CC-BY-NC 4.0", "Apache License 2.0", "BY-NC", "CC  BY 4.0", "Self-Recorded", "academic", "non  commercial, MIT"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(Q.licence_class(F.col("v"))).collect()]
    assert got == ["permissive", "non_permissive", "unknown", "unknown", "unknown", "unknown", "non_permissive", "permissive", "non_permissive", "permissive", "permissive", "unknown", "non_permissive"]
    models = spark.createDataFrame([(1, "d", "m", "weights", "MIT"), (2, "d", "m", "weights", "MIT"), (2, "d", "m", "code", "?")], "run_id int, stage string, model string, axis string, value string")
    assert {r.run_id: (r.passed, r.n_findings) for r in Q.certify(models).collect()} == {1: (True, 0), 2: (False, 1)}
    a = spark.createDataFrame([("x", "p", "1"), ("x", "q", "2"), ("y", "q", "2"), ("y", "p", "1")], "config string, path string, value string")
    assert len({r.hash for r in Q.config_hash(a).collect()}) == 1


def test_stage_registry():
    from touchline.plans import stages  # noqa: F401

    assert ("track", "iou") in Q.registered()
    with pytest.raises(KeyError, match="no track stage"):
        Q.build("track", "none-such")
    with pytest.raises(ValueError, match="registered already"):
        Q.stage("track", "iou")(lambda df: df)


def test_entry_without_the_corpus_operators():
    """__spark_entry__ imports and lists the other queries when the corpus folders and the pipeline are gone."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['touchline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])

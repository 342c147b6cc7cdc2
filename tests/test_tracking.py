"""Rules of runs, matchers, evaluation, pairs, trackers, formations, files and streams."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import benchmark, evaluation, evidence, formation, pairs, robustness, runs, tracker
from touchline.sources import files
from touchline.streaming import live

BOXES = "clip long, frame long, det_id long, tracklet_id long, x double, y double, w double, h double, confidence double"
TRUTH = "clip long, frame long, gt_id long, x double, y double, w double, h double"
ACTIONS = "clip long, event_id long, class_id int, slot int, frame long, score double"


def timeline(spark, text):
    """One letter a frame; '.' nobody, ' ' a missing frame."""
    rows = [(1, i, None if c == "." else ord(c) - 97, None if c == "." else (ord(c) - 97) % 2, 0.9) for i, c in enumerate(text) if c != " "]
    return spark.createDataFrame(rows, "clip long, frame long, possessor long, team long, confidence double")


def test_possession_segments_fuse_and_drop_short_runs(spark):
    got = runs.possession_segments(timeline(spark, "aaabaaa.bbb cccc")).orderBy("segment").collect()
    assert [(r.possessor, r.start, r.end, r.n_frames) for r in got] == [(0, 0, 6, 6), (1, 8, 10, 3), (2, 12, 15, 4)]
    events = sorted((r.frame, r.type, r.player_id, r.receiver) for r in runs.transition_events(timeline(spark, "aaaaaaabbb.cccc")).collect())
    assert events == [(0, "reception", 0, None), (6, "pass", 0, 1), (9, "pass", 1, 2), (11, "reception", 2, None)]


def test_smoothing_keeps_its_own_label_on_ties(spark):
    assert [r.possessor for r in runs.smoothed(timeline(spark, "aabb")).orderBy("frame").collect()] == [0, 0, 1, 1]
    assert [r.possessor for r in runs.smoothed(timeline(spark, "abcab"), 1).orderBy("frame").collect()] == [0, 1, 2, 0, 1]
    one = [r.possessor for r in runs.smoothed(timeline(spark, "aaabaaa")).orderBy("frame").collect()]
    assert one == [0] * 7


def test_ball_gaps(spark):
    ball = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.8), (1, 4, 8.0, 4.0, 0.6), (1, 50, 0.0, 0.0, 1.0)], "clip long, frame long, x double, y double, confidence double")
    got = {r.frame: r for r in runs.interpolated_ball(ball, 30).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 50] and (got[1].x, got[1].y, got[1].confidence, got[1].interpolated) == (2.0, 1.0, 0.3, True)


def test_suppression_is_greedy_by_score(spark):
    rows = spark.createDataFrame([(1, 10, 0.9), (1, 30, 0.8), (1, 35, 0.95), (1, 60, 0.1)], "clip long, frame long, score double")
    assert sorted(r.frame for r in runs.suppress(rows, ["clip"], 25).collect()) == [35]
    assert sorted(r.frame for r in runs.suppress(rows, ["clip"], 24).collect()) == [10, 35, 60]


def test_camera_shift_is_the_upper_median(spark):
    rows = [(1, f, f * 10 + k, k, float(f * (k + 1)), 0.0, 1.0, 1.0, 1.0) for f in (0, 1) for k in range(4)]
    assert runs.camera_shift(spark.createDataFrame(rows, BOXES)).first().shift_x == 3.0


def test_viterbi_prefers_few_switches(spark):
    frames = range(12)
    ball = spark.createDataFrame([(1, f, 50.0, 0.0, 1.0, False) for f in frames], "clip long, frame long, x double, y double, confidence double, interpolated boolean")
    boxes = [(1, f, f * 2 + k, k, 40.0 + 20 * k - (8 if f == 5 and k else 0), 0.0, 5.0, 5.0, 1.0) for f in frames for k in (0, 1)]
    teams = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "clip long, tracklet_id long, team long")
    got = [r.possessor for r in runs.viterbi_possession(ball, spark.createDataFrame(boxes, BOXES), teams).orderBy("frame").collect()]
    assert set(got) == {0}


def test_detections_match_by_confidence_and_report_duplicates(spark):
    dets = spark.createDataFrame([(1, 0, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0, 2, 2, 1.0, 0.0, 10.0, 10.0, 0.95), (1, 0, 3, 3, 100.0, 0.0, 10.0, 10.0, 0.5), (1, 9, 4, 3, 0.0, 0.0, 1.0, 1.0, 0.5)], BOXES)
    truth = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 10.0, 10.0), (1, 0, 8, 500.0, 0.0, 10.0, 10.0)], TRUTH)
    got = {r.det_id: r for r in evaluation.match_frames(dets, truth).collect()}
    assert sorted(got) == [1, 2, 3] and got[2].gt_id == 7 and got[1].gt_id is None and got[1].duplicate and not got[3].duplicate
    r = evaluation.detection_report(evaluation.match_frames(dets, truth), truth).first()
    assert (r.n_true, r.n_matched, r.ap, r.precision, r.recall) == (2, 1, 0.5, pytest.approx(0.3333), 0.5)


def test_average_precision_by_hand(spark):
    flags = spark.createDataFrame([(1, k, h) for k, h in enumerate([True, False, True, False], 1)], "k int, place int, hit boolean")
    totals = spark.createDataFrame([(1, 3), (2, 1)], "k int, n_true long")
    got = {r.k: r.ap for r in evaluation.average_precision(flags, totals, ["k"]).collect()}
    assert got == {1: round((1 + 2 / 3) / 3, 4), 2: 0.0}


def test_claims_take_the_nearest_free_label(spark):
    predictions = spark.createDataFrame([(1, 1, 1, 0, 100, 0.9), (1, 2, 1, 0, 101, 0.8), (1, 3, 1, 0, 300, 0.7), (1, 4, 2, 0, 100, 0.99)], ACTIONS)
    truth = spark.createDataFrame([(1, 10, 1, 0, 101, True), (1, 11, 1, 0, 110, True), (1, 12, 1, 1, 300, True)], "clip long, event_id long, class_id int, slot int, frame long, has_box boolean")
    got = {r.event_id: r.gt_event for r in evaluation.claim(predictions, truth, ["clip", "slot", "class_id"], 12).collect()}
    assert got == {1: 10, 2: 11, 3: None, 4: None}
    s = evaluation.action_summary(evaluation.action_report(predictions, truth)).first()
    assert (s.tp, s.fp, s.fn) == (2, 2, 1) and s.macro_f1 == pytest.approx(2 * (2 / 3) * (2 / 3) / (4 / 3), abs=1e-4)
    assert sorted(r.verdict for r in evaluation.verdicts(predictions, truth).collect()) == ["fn", "fp", "fp", "tp", "tp"]


def test_fused_models_need_company(spark):
    a = spark.createDataFrame([(1, 1, 1, 0, 100, 0.8), (1, 2, 1, 0, 200, 0.9), (1, 3, 4, 0, 50, 0.9)], ACTIONS)
    b = spark.createDataFrame([(1, 1, 1, 0, 108, 0.6)], ACTIONS)
    got = evaluation.fused_models([a, b], solo_classes=(4,)).orderBy("frame").collect()
    assert [(r.frame, r.n_models) for r in got] == [(50, 1), (100, 2)] and got[1].score == pytest.approx(0.7) and got[0].score == pytest.approx(0.9 * 0.5**0.5)


def test_hungarian_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 6), (6, 4), (1, 5), (7, 7)):
        cost = rng.normal(size=(n, m))
        r, c = evaluation.hungarian(cost)
        small, large = min(n, m), max(n, m)
        best = min(sum((cost[i, p[i]] if n <= m else cost[p[i], i]) for i in range(small)) for p in itertools.permutations(range(large), small))
        assert cost[r, c].sum() == pytest.approx(best) and len(set(r)) == len(set(c)) == small


def test_hota_is_one_for_perfect_tracks_and_falls_with_a_switch(spark):
    truth = [(1, f, g, 100.0 * g, 0.0, 10.0, 10.0) for f in range(10) for g in (1, 2)]
    perfect = [(1, f, f * 10 + g, g, 100.0 * g, 0.0, 10.0, 10.0, 1.0) for f in range(10) for g in (1, 2)]
    swapped = [(1, f, d, (t if f < 5 else 3 - t), *rest) for _, f, d, t, *rest in perfect]
    t = spark.createDataFrame(truth, TRUTH)
    assert evaluation.hota(spark.createDataFrame(perfect, BOXES), t).first().HOTA == pytest.approx(1)
    r = evaluation.hota(spark.createDataFrame(swapped, BOXES), t).first()
    assert r.DetA == pytest.approx(1) and r.AssA == pytest.approx(1 / 3, abs=1e-6) and r.HOTA == pytest.approx(math.sqrt(1 / 3), abs=1e-6)


def test_purity_majority_goes_to_the_lowest_id_on_ties(spark):
    truth = spark.createDataFrame([(1, f, 1 if f < 2 else 2, 0.0, 0.0, 10.0, 10.0) for f in range(4)], TRUTH)
    dets = spark.createDataFrame([(1, f, f, 5, 0.0, 0.0, 10.0, 10.0, 1.0) for f in range(5)], BOXES)
    r = evaluation.tracklet_purity(dets, truth).first()
    assert (r.length, r.matched_frames, r.majority_gt, r.purity, r.mixed_frames) == (5, 4, 1, 0.5, 2)


def test_switches(spark):
    rows = spark.createDataFrame([(1, 1, f, 1 if f < 30 else (2 if f < 35 else 1 if f < 60 else 3)) for f in range(100)], "clip long, gt_id long, frame long, hyp_id long")
    got = {r.threshold_s: r.n_switches for r in runs.persistent_switches(rows, 25.0, (0.1, 0.5)).collect()}
    assert got == {0.1: 3, 0.5: 1}
    assert [r.frame for r in evaluation.switch_instances(rows).orderBy("frame").collect()] == [30, 35, 60]
    other = rows.withColumn("hyp_id", F.when(F.col("frame") < 62, 1).otherwise(3))
    outcome = sorted(r.outcome for r in evaluation.switch_diff(evaluation.switch_instances(rows), evaluation.switch_instances(other), 5).collect())
    assert outcome == ["fixed", "fixed", "persisted"]


TRACKLETS = "clip long, tracklet_id long, start long, end long, team long, label long, embedding array<double>"


def tracklets(spark):
    rows = [(1, 1, 0, 10, 0, 7, [1.0, 0.0]), (1, 2, 12, 20, 0, 7, [0.9, 0.1]), (1, 3, 5, 15, 0, 8, [0.0, 1.0]), (1, 4, 30, 40, 0, 8, [0.1, 1.0]), (1, 5, 30, 40, 1, 9, [1.0, 0.0]), (1, 6, 50, 60, None, 7, [1.0, 0.05])]
    return spark.createDataFrame(rows, TRACKLETS)


def test_gates_give_the_first_reason_and_null_teams_pass(spark):
    rows = pairs.gated(pairs.pairs(tracklets(spark).drop("embedding")), [pairs.overlap_reason(), pairs.team_reason()])
    got = {(r.a_tracklet_id, r.b_tracklet_id): r.reason for r in rows.collect()}
    assert got[1, 3] == "temporal_overlap" and got[1, 5] == "team_mismatch" and got[1, 2] is None and got[5, 6] is None and got[4, 5] == "temporal_overlap"


def test_mutual_best_and_ordered_merging(spark):
    t = tracklets(spark)
    best = pairs.mutual_best(pairs.scored_pairs(t))
    got = {(r.a, r.b): r.same for r in best.collect()}
    assert got[3, 4] is True and all(a < b for a, b in got)
    edges = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.8), (1, 3, 4, 0.7), (1, 2, 6, 0.6)], "clip long, a long, b long, score double")
    merged = {r.tracklet_id: r.thread_id for r in pairs.merge_tracklets(t, edges).collect()}
    assert merged == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 1}  # 2 and 3 overlap: vetoed


def test_retrieval_and_budget(spark):
    scored = pairs.scored_pairs(tracklets(spark))
    r = {x.item: x for x in pairs.retrieval(scored).collect()}
    assert r[3].top1_correct and r[3].average_precision == 1.0
    counts = spark.createDataFrame([(0.1, 10, 5), (0.2, 8, 1), (0.3, 8, 0)], "threshold double, correct long, wrong long")
    got = {x.budget: (x.correct, x.wrong, x.threshold) for x in pairs.budget_curve(counts, [0, 1, 9]).collect()}
    assert got == {0: (8, 0, 0.3), 1: (8, 0, 0.3), 9: (10, 5, 0.1)}
    assert pairs.budget_curve(counts.where("wrong > 0"), [0]).first().threshold is None


def test_names_are_not_given_twice_to_overlapping_threads(spark):
    threads = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 50, 150), (1, 3, 200, 300), (1, 4, 0, 10)], "clip long, thread_id long, start long, end long")
    anchors = spark.createDataFrame([(1, 1, "a", 5.0), (1, 2, "a", 3.0), (1, 3, "a", 2.0)], "clip long, thread_id long, candidate string, log_lr double")
    got = {r.thread_id: r for r in pairs.with_tiers(pairs.decode_names(threads, anchors, ["a", "b"])).collect()}
    assert (got[1].label, got[2].label, got[3].label, got[4].label) == ("a", None, "a", None)
    assert (got[1].tier, got[2].tier) == ("auto_accept", "qa")


def test_calibrator_is_monotone(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(0.7, 0.1)), True) for _ in range(300)] + [(float(rng.normal(0.4, 0.15)), False) for _ in range(600)]
    fit = pairs.Calibrator.fit(spark.createDataFrame(rows, "score double, same boolean"))
    got = [r[0] for r in spark.createDataFrame([(i / 20,) for i in range(21)], "s double").orderBy("s").select(fit.column(F.col("s"))).collect()]
    assert all(b >= a - 1e-9 for a, b in zip(got, got[1:], strict=False)) and got[0] < -1 < 1 < got[-1] and abs(got[-1]) <= 6


def test_isotonic():
    x, y = pairs.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4), np.arange(4.0))
    assert y.tolist() == [1.0, 2.5, 4.0] and x.tolist() == [0.0, 1.5, 3.0]


def test_tracker_bridges_a_miss_and_drops_short_tracks(spark):
    rows = [(1, f, f * 10, 0, 5.0 * f, 0.0, 40.0, 40.0, 1.0) for f in range(10) if f != 4] + [(1, 3, 99, 0, 900.0, 0.0, 5.0, 5.0, 1.0)]
    got = tracker.iou_tracker(spark.createDataFrame(rows, BOXES)).collect()
    assert len(got) == 9 and len({r.track_id for r in got}) == 1


def test_refinement_splits_and_rejoins(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 1, f, a if f < 3 else b) for f in range(6)] + [(1, 2, f, a) for f in range(8, 10)]
    df = spark.createDataFrame(rows, "clip long, tracklet_id long, frame long, feature array<double>")
    assert [(r.tracklet_id, r.frame) for r in tracker.split_frames(df, 0.5).collect()] == [(1, 3)]
    got = {r.frame: r.refined_id for r in tracker.refined_tracklets(df, 0.5, 0.1, 10).collect()}
    assert [got[f] for f in (0, 3, 8)] == [0, 1, 0]


def test_trajectories_reject_outliers_and_fill_plausible_gaps(spark):
    rows = [(1, 1, f, 10.0 * f if f != 6 else 5000.0, 0.0) for f in range(20) if f not in (10, 11)] + [(1, 1, 60, 600.0, 0.0)]
    got = {r.frame: r for r in tracker.smoothed_tracks(spark.createDataFrame(rows, "clip long, entity long, frame long, x double, y double")).collect()}
    assert got[6].status == "smoothed" and got[10].status == "interpolated" and got[10].x == pytest.approx(100, abs=2) and 30 not in got


def test_formations(spark):
    from touchline.operators.formation import adjacency, change_points, formation_lines

    slots = spark.createDataFrame([(1, 0, s, x) for s, x in enumerate([0.0, 0.01, 0.02, 0.03, 0.4, 0.42, 0.44, 0.9, 0.95, 1.0])], "clip long, team long, slot int, mean_x double")
    assert formation_lines(slots).first().formation == "4-3-3"
    assert change_points(np.array([[0, 1, 2, 3]] * 20 + [[3, 2, 1, 0]] * 20)) == [20] and change_points(np.array([[0, 1]] * 30)) == []
    square = adjacency(np.array([[0.0, 0], [1, 0], [0, 1], [1.1, 1.2]]))
    assert square[0, 1] and square[0, 2] and not square[0, 0]
    rows = [(1, 0, f, p, p / 10 + 0.001 * (f % 3), (p * 7 % 10) / 10) for f in range(12) for p in range(10)]
    rel = formation.relative(spark.createDataFrame(rows, "clip long, team long, frame long, player_id long, x double, y double"))
    got = formation.role_slots(rel).collect()
    assert len({(r.player_id, r.slot) for r in got}) == 10


def test_evidence(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 1.0), (2, 0.99, 0.99)], "k int, x double, y double")
    got = {r.k: r for r in evidence.occupancy(points, ["k"]).withColumn("cells", evidence.footprint(F.col("counts"))).collect()}
    assert sum(got[1].counts) == 2 and got[1].counts[0] == 1 and got[1].counts[-1] == 1 and sum(got[2].cells) == pytest.approx(1)
    one = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.5, 0.5])], "p array<double>, q array<double>, r array<double>")
    d = one.select(evidence.js_distance(F.col("p"), F.col("q")), evidence.js_distance(F.col("p"), F.col("p")), evidence.js_distance(F.col("p"), F.col("r"))).first()
    assert d[0] == pytest.approx(1) and d[1] == pytest.approx(0) and 0 < d[2] < 1
    flat = [0.01] * 100
    sharp = [0.0] * 7 + [1.0] + [0.0] * 92
    llr = spark.createDataFrame([(sharp, sharp, flat), (sharp, flat, flat)], "a array<double>, b array<double>, p array<double>").select(evidence.number_llr(F.col("a"), F.col("b"), F.col("p"))).collect()
    assert llr[0][0] > 3 and llr[1][0] == pytest.approx(0)


def test_robustness(spark):
    from tests.test_match_statistics import SCHEMA, event

    df = spark.createDataFrame([event(i, "pass", 0, opponents=[(5000, 3400)] * (i % 5)) for i in range(2000)], SCHEMA)
    kept = robustness.scenarios(df, rates=(0.1,), trials=3).groupBy("model", "trial").count().collect()
    assert len(kept) == 6 and all(abs(r["count"] - 1800) < 80 for r in kept)
    moves = spark.createDataFrame([("s", m, r, v) for m in ("u", "c") for r, v in ((0.1, 0.05), (0.2, 0.05 if m == "u" else 0.3), (0.4, 0.01))], "stat string, model string, rate double, mean_relative_movement double")
    assert robustness.gating(moves).first().tolerated_rate == 0.1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,3,10,20,30,40\n2,3,11,20,30,40,0.5,-1\n\nbroken\n")
    rows = files.read_mot(spark, str(tmp_path / "a.txt")).orderBy("frame").collect()
    assert [(r.frame, r.track_id, r.confidence, r.malformed) for r in rows] == [(None, None, 1.0, True), (0, 3, 1.0, False), (1, 3, 0.5, False)]
    with pytest.raises(Exception, match="refused row"):
        files.checked_tracks(files.read_mot(spark, str(tmp_path / "a.txt"))).collect()
    (tmp_path / "g.ini").write_text("[Sequence]\nname = x\ntrackletID_7= player team left;10\ntrackletID_8= referee;main\ntrackletID_9= goalkeepers team right;x\n;c=1\n")
    roles = {r.track_id: (r.role, r.team, r.jersey) for r in files.track_roles(files.read_ini(spark, str(tmp_path / "g.ini"))).collect()}
    assert roles == {7: ("player", "left", "10"), 8: ("referee", None, None), 9: ("goalkeeper", "right", None)}
    wide = spark.createDataFrame([(1, 1.0, 2.0, None, 4.0)], "frame long, home_1_x double, home_1_y double, away_2_x double, away_2_y double")
    long = {(r.team, r.player): (r.x, r.y) for r in files.unpivot_positions(wide).collect()}
    assert long == {("home", "1"): (1.0, 2.0), ("away", "2"): (None, 4.0)}
    folder = files.RunFolder(spark, str(tmp_path / "run"))
    folder.write("rows", spark.range(3), "json")
    assert folder.exists("rows") and not folder.exists("none") and folder.read("rows", "id long", "json").count() == 3
    (tmp_path / "run/list.json").write_text('[{"a": 1}, {"a": 2}]')
    assert folder.read_array("list.json", "a int").count() == 2
    shirts = spark.createDataFrame([(1, 0, f, s) for f, s in enumerate([None, 7, None, 9])], "clip long, slot int, frame long, shirt int")
    assert [r.shirt for r in files.slot_shirts(shirts).orderBy("frame").collect()] == [7, 7, 7, 9]
    starts = spark.range(1).select(files.window_starts(F.lit(0), F.lit(99), 40, 25)).first()[0]
    assert starts == [0, 25, 50, 60]
    means = spark.createDataFrame([(1, 0, [1.0, 1.0]), (1, 1, [3.0])], "clip long, start long, scores array<double>")
    assert {r.frame: r.score for r in files.window_means(means).collect()} == {0: 1.0, 1: 2.0}


def test_manifest(spark):
    held = spark.createDataFrame([("a", "tuning", 1), ("b", "test", 1)], "name string, role string, n int")
    new = spark.createDataFrame([("b", "test", 2), ("c", "test", 1)], "name string, role string, n int")
    assert [tuple(r) for r in files.upsert_manifest(held, new).collect()] == [("a", "tuning", 1), ("b", "test", 2), ("c", "test", 1)]
    with pytest.raises(Exception, match="tuning"):
        files.upsert_manifest(held, spark.createDataFrame([("a", "test", 2)], "name string, role string, n int")).collect()


def test_benchmark_refuses_other_sequences(spark):
    rows = spark.createDataFrame([("base", 1, "m", 0.5), ("x", 1, "m", 0.7), ("y", 2, "m", 0.9), ("z", 1, "m", 0.4)], "candidate string, sequence int, metric string, value double")
    assert {r.candidate: r.verdict for r in benchmark.compare(rows, "base", 0.1).collect()} == {"x": "improved", "y": "sequence_mismatch", "z": "within_tolerance"}


def frames(spark):
    rows = [(c, f, (f // 4) % 3 if f % 11 else None, ((f // 4) % 3) % 2, f == 20) for c in (1, 2) for f in range(60)]
    return spark.createDataFrame(rows, "clip long, frame long, player_id long, team long, out boolean")


def test_streaming_equals_batch(spark, tmp_path):
    """The same rows in several files, one a trigger, through the state machine and through tumbling buckets."""
    batch = frames(spark)
    want = sorted(map(tuple, live.possession_events(batch).collect()), key=str)
    for k in range(3):
        batch.where(f"frame >= {20 * k} and frame < {20 * k + 20}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for k in range(3):  # in order of time: the source reads the oldest file first
        for part in (tmp_path / f"in/{k}").glob("part-*.parquet"):
            (tmp_path / "all").mkdir(exist_ok=True)
            part.rename(tmp_path / "all" / f"{k}-{part.name}")
            import os

            os.utime(tmp_path / "all" / f"{k}-{part.name}", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = live.read_events(spark, str(tmp_path / "all"), "clip long, frame long, player_id long, team long, out boolean")
    query = live.possession_events(stream).writeStream.format("memory").queryName("holds").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("holds").collect()), key=str) == want
    assert {r[2] for r in want} >= {"touch", "pass", "missed_pass", "possession_gain", "restart"}


def test_events_of_a_hold_are_where_it_begins_and_ends(spark):
    """Player 1 holds frames 0 to 5, 2 of the same team 8 to 12, 3 of another from 13, 4 of no known team from 20."""
    near = {**dict.fromkeys(range(6), (1, 0)), **dict.fromkeys(range(8, 13), (2, 0)), **dict.fromkeys(range(13, 20), (3, 1)), **dict.fromkeys(range(20, 26), (4, None))}
    rows = [(1, f, *near.get(f, (None, None)), False, 0.5 if f < 8 else 0.9, f == 10) for f in range(26)]
    got = live.possession_events(spark.createDataFrame(rows, "clip long, frame long, player_id long, team long, out boolean, confidence double, contested boolean")).collect()
    want = [(0, "touch", 1, None, 0.5, False), (5, "pass", 1, 2, 0.5, True), (8, "touch", 2, None, 0.9, True), (12, "missed_pass", 2, 3, 0.9, False), (15, "possession_gain", 3, 2, 0.9, False), (13, "touch", 3, None, 0.9, False)]
    want += [(19, "missed_pass", 3, 4, 0.9, False), (22, "possession_gain", 4, 3, 0.9, False), (20, "touch", 4, None, 0.9, False)]
    assert [tuple(r)[1:] for r in got] == want


def test_streamed_homographies_equal_batch(spark, tmp_path):
    """Frames in several files, one a trigger: the mean and what is carried go on from file to file."""
    import os

    h = lambda x: [[1.0, 0.0, x], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(c, f, h(float(f * c)) if f % 5 < 3 else None, 0.8) for c in (1, 2) for f in range(18)]
    schema = "clip long, frame long, homography array<array<double>>, confidence double"
    batch = spark.createDataFrame(rows, schema)
    key = lambda found: sorted((r.clip, r.frame, r.status, round(r.confidence, 9), r.homography and round(r.homography[0][2], 9)) for r in found)
    (tmp_path / "all").mkdir()
    for k in range(6):
        batch.where(f"frame >= {3 * k} and frame < {3 * k + 3}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for part in (tmp_path / f"in/{k}").glob("part-*.parquet"):
            part.rename(tmp_path / "all" / f"{k}-{part.name}")
            os.utime(tmp_path / "all" / f"{k}-{part.name}", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = live.smoothed_homographies(live.read_events(spark, str(tmp_path / "all"), schema), most_carried=1)
    query = stream.writeStream.format("memory").queryName("smooth").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    want = key(live.smoothed_homographies(batch, most_carried=1).collect())
    assert key(spark.table("smooth").collect()) == want and {r[2] for r in want} == {"fresh", "smoothed", "carried", "absent"}


def test_stream_buckets_and_late_rows(spark, tmp_path):
    schema = "match_id long, ts timestamp, type string"
    rows = [(1, s, "shot" if s % 5 == 0 else "pass") for s in range(100)]
    df = spark.createDataFrame(rows, "match_id long, s long, type string").select("match_id", F.timestamp_seconds("s").alias("ts"), "type")
    for k, condition in enumerate(["ts < timestamp_seconds(50)", "ts >= timestamp_seconds(50)"]):
        df.where(condition).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.tumbling_counts(live.read_events(spark, str(tmp_path / "in"), schema, 10), 10)
    query = stream.writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    final = {r.start: (r.n_events, r.n_shots) for r in spark.table("buckets").collect()}
    want = {r.start: (r.n_events, r.n_shots) for r in live.tumbling_counts(df, 10).collect()}
    assert final and all(want[k] == v for k, v in final.items())
    gaps = spark.createDataFrame([(1, s) for s in (0, 10, 21, 22)], "match_id long, s long").select("match_id", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.n_events for r in live.sessions(gaps, 10).collect()) == [2, 2]


def test_homographies_are_carried_for_a_while(spark):
    h = [[1.0, 0.0, 10.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(1, 0, None, 0.0), (1, 1, h, 1.0), (1, 2, None, 0.0), (1, 3, None, 0.0), (1, 4, None, 0.0)]
    got = live.smoothed_homographies(spark.createDataFrame(rows, "clip long, frame long, homography array<array<double>>, confidence double"), most_carried=2).orderBy("frame").collect()
    assert [r.status for r in got] == ["absent", "fresh", "carried", "carried", "absent"] and got[3].confidence == pytest.approx(0.81)

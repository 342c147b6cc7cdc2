"""Loaders of halves, plays, labelled clips and sequences: round trips through files, and the rows of small cases."""

import hashlib
import json

import pytest

from touchline.sources import halves as H

HALF = "half_key string, row long, frame long, player_id long, side int, shirt long, role int, roi_x double, roi_y double, roi_w double, roi_h double, class_id int"


def rows(spark, *given):
    return spark.createDataFrame([("g_1_H2", i, *r) for i, r in enumerate(given)], HALF)


def test_half_events_keep_labelled_rows_with_a_slot(spark):
    table = rows(spark, (50, 101, 0, 9, 1, None, None, None, None, 2), (75, 201, 1, None, 13, 3.0, 6.0, 3.0, 3.0, 5), (80, 201, 1, 7, 14, 3.0, 6.0, 3.0, 3.0, 5), (81, 201, 1, 7, None, 3.0, 6.0, 3.0, 3.0, 5), (82, 201, 1, 7, 2, 3.0, 6.0, 3.0, 3.0, 0), (83, 201, 1, 7, 2, 3.0, 6.0, 3.0, 3.0, None))
    found = [(r.game_id, r.half, r.frame, r.slot, r.slot_name, r.shirt, r.t, r.has_box) for r in H.half_events(table).orderBy("row").collect()]
    assert found == [("g_1", 2, 50, 0, "L-GK", 9, 2.0, False), ("g_1", 2, 75, 25, "R-RB", -1, 3.0, True)]
    with pytest.raises(ValueError):
        H.half_events(table.drop("class_id"))


def test_half_tracklets_are_what_is_on_screen(spark):
    table = rows(spark, (2, 305, 1, 5, 2, 6.0, 3.068181, 3.0, 6.136362, 0), (1, 305, 0, 5, 2, 0.0, 0.0, 3.0, 3.068181, 0), (3, 305, 1, 5, 2, None, None, None, None, 0), (1, 306, 1, 6, 3, None, None, None, None, 4))
    found = H.half_tracklets(table).orderBy("frame").collect()
    assert [(r.tracklet_id, r.club, r.frame, r.team) for r in found] == [(305, 3, 1, "home"), (305, 3, 2, "home")]
    assert (found[1].x1, found[1].y1, found[1].x2, found[1].y2) == pytest.approx((2.0, 1.0, 3.0, 3.0))


def test_shirts_go_back_then_ahead(spark):
    box = (None, None, None, None)
    table = rows(spark, (5, 1, 0, None, 3, *box, 2), (10, 1, 0, 8, 3, *box, 2), (10, 2, 0, 9, 3, *box, 0), (20, 1, 0, None, 3, *box, 2), (30, 3, 0, 4, 3, *box, 2), (30, 4, 1, None, 3, *box, 1))
    found = {r.row: r.shirt for r in H.with_shirts(H.half_events(table), table).collect()}
    assert found == {0: 9, 1: 9, 3: 9, 4: 4, 5: -1}


def test_plays_need_their_kind(spark, tmp_path):
    path = tmp_path / "plays.json"
    path.write_text(json.dumps({"keys": ["a_H1"], "events": {"a_H1": [[10, 0, 7, 2, 1, 0], [11, 1, 8, 3, 0, 1], [1, 2, 3]], "b_H1": [[1, 1, 1, 1]]}}))
    truth = [(r.half_key, r.frame, r.side, r.shirt, r.class_id, r.score, r.has_box, r.is_replay) for r in H.read_plays(spark, str(path), "gt").orderBy("row").collect()]
    assert truth == [("a_H1", 10, 0, 7, 2, 1.0, True, False), ("a_H1", 11, 1, 8, 3, 1.0, False, True)]
    path.write_text(json.dumps({"keys": ["a_H1", "c_H2"], "events": {"a_H1": [[10, 0, 7, 2, 0.25], [12, 0, 7, 2]]}}))
    assert [(r.score, r.has_box) for r in H.read_plays(spark, str(path), "pred").orderBy("row").collect()] == [(0.25, None), (1.0, None)]
    with pytest.raises(ValueError):
        H.read_plays(spark, str(path), "both")


def test_replays_are_told_by_the_labelled_play(spark):
    events = spark.createDataFrame([("a_H1", 10, 0, 7, 2), ("a_H1", 11, 0, 7, 2)], "half_key string, frame long, side long, shirt long, class_id long")
    plays = spark.createDataFrame([("a_H1", 0, 10, 0, 7, 2, True)], "half_key string, row int, frame long, side long, shirt long, class_id long, is_replay boolean")
    assert {(r.frame, r.is_replay) for r in H.with_replays(events, plays).collect()} == {(10, True), (11, False)}


def test_event_truth(spark, tmp_path):
    good, other, broken = tmp_path / "good.json", tmp_path / "other.json", tmp_path / "broken.json"
    good.write_text(json.dumps({"source": "s", "sequence": "q", "fps": 25.0, "kind": "action_events", "events": [{"class": "PASS", "frame_idx": 3, "t": 0.12, "half": 1}]}))
    other.write_text(json.dumps({"source": "s", "tracks": []}))
    broken.write_text("{no")
    assert [(r.sequence, r["class"], r.frame, r.half) for r in H.read_event_truth(spark, str(good)).collect()] == [("q", "PASS", 3, 1)]
    assert H.is_event_truth(spark, str(good))
    assert not any(H.is_event_truth(spark, str(p)) for p in (other, broken, tmp_path / "absent.json"))
    with pytest.raises(Exception, match="no labelled actions"):
        H.read_event_truth(spark, str(other)).collect()


def test_clip_actions_only_where_they_can_be_seen(spark):
    def clip(folder, **kv):
        return [(folder, k, v) for k, v in kv.items()]

    base = {"name": "S", "actionClass": "Goal", "actionPosition": "5500", "clipStart": "1000", "clipStop": "31000", "frameRate": "25"}
    settings = clip("a", **base) + clip("b", **base, visibility="not shown") + clip("c", **{**base, "actionPosition": "900"}) + clip("d", **{**base, "actionPosition": "31001"}) + clip("e", name="E", frameRate="25")
    found = H.clip_actions(spark.createDataFrame(settings, "clip string, key string, value string")).collect()
    assert [(r.clip, r.sequence, r["class"], r.frame, r.t) for r in found] == [("a", "S", "Goal", 112, 4.5)]


def test_sequences_and_hashes(spark, tmp_path):
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "gt.txt").write_text("1,4,10,20,30,40,1\n2,4,11,20,30,40,1\n1,5,0,0,5,5,1\n")
    (tmp_path / "gameinfo.ini").write_text("[Sequence]\ntrackletID_4=player team left;10\ntrackletID_5=referee;main\n")
    (tmp_path / "seqinfo.ini").write_text("[Sequence]\nframeRate=50\n")
    named = {(r.track_id, r.frame): (r.role, r.team, r.jersey, r.x2, r.y2, r.fps) for r in H.read_sequence(spark, str(tmp_path)).collect()}
    assert named == {(4, 0): ("player", "left", "10", 40.0, 60.0, 50.0), (4, 1): ("player", "left", "10", 41.0, 60.0, 50.0), (5, 0): ("referee", None, None, 5.0, 5.0, 50.0)}
    assert {r.role for r in H.read_sequence(spark, str(tmp_path), named=False).collect()} == {"player"}
    text = (tmp_path / "seqinfo.ini").read_bytes()
    assert [(r.length, r.sha256) for r in H.file_hashes(spark, str(tmp_path / "seqinfo.ini")).collect()] == [(len(text), hashlib.sha256(text).hexdigest())]

"""Names, causes of switches, evidence by channel and exports, against the rules worked by hand or by loops."""

import json
import random

import pytest

from touchline.operators import reports as O
from touchline.operators.pairs import Calibrator

SWITCH = "clip long, gt_id long, frame long"


def by_hand(a, b, tolerance):
    """Nearest pairs first, each used once, equal distances in the order of a, then of b."""
    near = sorted((abs(x - y), x, y) for x in a for y in b if abs(x - y) <= tolerance)
    taken, used = {}, set()
    for _, x, y in near:
        if x not in taken and y not in used:
            taken[x] = y
            used.add(y)
    return taken


def test_switches_get_the_layer_they_come_from(spark):
    deal = random.Random(3)
    draw = lambda: {(c, g): sorted(deal.sample(range(120), deal.randint(0, 6))) for c in range(2) for g in range(4)}
    low, high, oracle = draw(), draw(), draw()
    frames = lambda d: spark.createDataFrame([(c, g, f) for (c, g), at in d.items() for f in at], SWITCH)
    want = set()
    for key in low:
        kept, carried = by_hand(low[key], oracle[key], 10), by_hand(high[key], low[key], 10)
        cause = {f: "online_association" if f in kept else "detection" for f in low[key]}
        want |= {(*key, f, "tracklet", cause[f], kept.get(f)) for f in low[key]}
        want |= {(*key, f, "entity", cause[carried[f]] if f in carried else "offline_association", carried.get(f)) for f in high[key]}
    found = O.switch_attribution(frames(low), frames(high), frames(oracle), tolerance=10).collect()
    assert {(r.clip, r.gt_id, r.frame, r.level, r.layer, r["at"]) for r in found} == want
    alone = O.switch_attribution(frames(low), frames(high), tolerance=10).collect()
    assert {r.layer for r in alone if r.level == "tracklet"} == {"ambiguous"}
    pristine = O.switch_attribution(frames(low), frames(high), oracle_input=True, tolerance=10).collect()
    assert {r.layer for r in pristine if r.level == "tracklet"} == {"online_association"}
    with pytest.raises(ValueError):
        O.switch_attribution(frames(low), frames(high), frames(oracle), oracle_input=True)


def test_names_in_either_form_count_and_abstaining_costs_no_precision(spark):
    tracks = spark.createDataFrame([(1, 0, "player", "left", "10"), (1, 1, "player", "right", "A"), (1, 2, "referee", "left", "3"), (2, 0, "player", None, "4")], "clip long, gt_id long, role string, team string, jersey string")
    entities = spark.createDataFrame([(1, 0, 0, "left:10"), (1, 1, 0, "10"), (1, 2, 0, "right:10"), (1, 3, 0, None), (1, 4, 1, "left:9"), (1, 5, None, "left:10"), (2, 0, 0, "left:4")], "clip long, entity_id long, gt_id long, label string")
    found = O.naming_report(entities, tracks).collect()
    assert [tuple(r) for r in found] == [(1, 5, 4, 3, 2, 0.8, 0.2, 0.6667)]
    assert {r.clip: r.roster for r in O.roster(tracks).collect()} == {1: ["left:10"], 2: []}


def test_frames_outside_the_layout_are_refused(spark):
    layout = spark.createDataFrame([(1, 0, 40), (1, 1, 42)], "clip long, local long, source long")
    tracks = lambda *frames: spark.createDataFrame([(1, 7, f) for f in frames], "clip long, tracklet_id long, frame long")
    assert sorted(r.frame for r in O.remapped(tracks(0, 1), layout).collect()) == [40, 42]
    with pytest.raises(Exception, match="outside of the layout"):
        O.remapped(tracks(0, 2), layout).collect()


def test_events_move_to_their_touch(spark):
    rows = spark.createDataFrame([(1, 1, "pass", 10, 0.5, 13), (1, 2, "pass", 20, 0.5, None), (1, 3, "reception", 30, 0.5, 30)], "clip long, event_id long, type string, frame long, confidence double, touch_frame long")
    found = {r.event_id: (r.frame, r.t, r.refined_from, r["shift"]) for r in O.refined_timing(rows).collect()}
    assert found == {1: (13, 0.52, 10, 3), 2: (20, 0.8, None, None), 3: (30, 1.2, None, None)}
    touches = spark.createDataFrame([(1, f) for f in (13, 30, 50, 60)], "clip long, frame long")
    (total,) = O.corroboration_summary(rows, touches).collect()
    assert (total.n_events, total.matched, total.possession_only, total.trajectory_only, total.agreement_rate, total.touch_recall) == (3, 2, 1, 2, 0.6667, 0.5)
    assert [tuple(t) for t in total.by_type] == [("pass", 2, 1), ("reception", 1, 1)]
    assert O.corroboration_summary(rows.limit(0), touches).first().agreement_rate == 0.0


class Line(Calibrator):
    """A calibrator that multiplies."""

    def __init__(self, by):
        self.by = by

    def column(self, score):
        return score * self.by


def test_channels_abstain_and_add_up(spark):
    schema = "id long, body double, occupancy double, gap double, transition double, n_frames double"
    rows = [(1, 0.5, 0.2, 4.0, 1.5, 30.0), (2, None, 0.2, 4.0, 1.5, 30.0), (3, 0.5, None, 40.0, None, 0.0), (4, 0.5, 0.2, -2.0, 1.5, 10.0), (5, 0.5, float("nan"), 4.0, 1.5, 30.0)]
    pairs = spark.createDataFrame(rows, schema)
    scored = O.channel_scores(pairs, {"body": Line(2.0), "occupancy": Line(-1.0), "gap": Line(0.1)}, {"body": [(10.0, Line(4.0))]}, weights={"body": 0.5, "occupancy": 2.0}, weights_by_gap={"gap": [(10.0, 3.0)]}, required=("body",), shrink=10.0)
    found = {r.id: r for r in scored.collect()}
    assert found[1].score == pytest.approx(0.5 * 4 * 0.5 - 2 * 0.2 * 0.75 + 3 * 0.4 + 1.5)
    assert found[2].score is None and all(c.llr is None and c.contribution == 0 for c in found[2].channels)
    assert found[3].score == pytest.approx(0.5 * 2 * 0.5 + 4.0)
    assert found[4].score == pytest.approx(0.5 * 4 * 0.5 - 2 * 0.2 * 0.5)  # interleaved: the gap counts as 0, the transition abstains
    assert found[4].channels[3].raw == -2.0 and found[3].channels[3].raw is None
    assert found[5].score == pytest.approx(0.5 * 4 * 0.5 + 3 * 0.4 + 1.5)
    assert [c.name for c in found[1].channels] == ["body", "occupancy", "gap", "transition"]


def test_exports_and_jobs(spark):
    verdicts = spark.createDataFrame([(2, "pair", "same"), (1, "pair", "different"), (3, "pair", "unsure"), (4, "name", "same")], "id long, kind string, verdict string")
    assert [tuple(r) for r in O.pair_labels(verdicts).collect()] == [(1, "different"), (2, "same")]
    assert tuple(O.pair_label_counts(verdicts).first()) == (3, 2, 1)
    examples = spark.createDataFrame([(2, '{"a": {"b": 1}}'), (1, "{}")], "id long, payload string")
    assert [json.loads(r.value) for r in O.example_lines(examples).collect()] == [{"id": 1}, {"id": 2, "a": {"b": 1}}]
    jobs = spark.createDataFrame([("q", 3, "queued", 1), ("q", 2, "queued", 1), ("q", 1, "running", 0), ("r", 9, "done", 0)], "queue string, job_id long, status string, created long")
    assert [(r.queue, r.job_id) for r in O.first_free(jobs).collect()] == [("q", 2)]

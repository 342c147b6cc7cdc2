"""Hand-computed rules of the match event operators, one negative case a rule."""

import math

import pytest

from touchline.functions import pitch as G
from touchline.operators import chains, duels, models, players, sequences, teams

SCHEMA = (
    "match_id long, half int, event_id long, frame_idx long, t double, type string, player_id long, club_id long, role int, x double, y double, end_x double, end_y double, "
    "outcome string, outcome_source string, replay boolean, opponents array<struct<x:double,y:double>>, teammates array<struct<x:double,y:double>>"
)


def event(i, kind, club, t=None, player=..., x=5000.0, y=3400.0, end=None, half=1, match=1, outcome="unknown", source="none", replay=False, opponents=(), role=5):
    t = float(i if t is None else t)
    who = club * 100 + 1 if player is ... else player
    ex, ey = end or (None, None)
    return (match, half, i, int(t * 25), t, kind, who, club, role, x, y, ex, ey, outcome, source, replay, [tuple(map(float, p)) for p in opponents], [])


@pytest.fixture
def stream(spark):
    return lambda *events: spark.createDataFrame(list(events), SCHEMA)


def chained(df, **k):
    return {r.event_id: r for r in chains.with_chains(df, **k).collect()}


def test_chains_break_on_club_gap_and_half_but_not_on_contests(stream):
    got = chained(stream(event(1, "pass", 0), event(2, "tackle", 1), event(3, "pass", 0), event(4, "pass", 1), event(5, "pass", 1, t=20), event(6, "pass", 1, t=30), event(7, "pass", 1, t=1, half=2)))
    assert [got[i].chain_id for i in range(1, 8)] == [0, 0, 0, 1, 2, 2, 3]
    assert [got[i].gap_split for i in range(1, 8)] == [False, False, False, False, True, False, False]


def test_a_contest_that_opens_a_segment_owns_its_chain(stream):
    got = chained(stream(event(1, "tackle", 1), event(2, "pass", 1), event(3, "pass", 0)))
    assert [got[i].chain_id for i in (1, 2, 3)] == [0, 0, 1] and got[1].chain_club == 1


def test_matches_do_not_interleave_and_replays_go(stream):
    got = chained(stream(event(1, "pass", 0, match=1), event(2, "pass", 1, match=2), event(3, "pass", 0, match=1), event(4, "pass", 1, replay=True)))
    assert got[1].chain_id == got[3].chain_id == 0 and got[2].chain_id == 0 and 4 not in got


def test_outcomes_and_receivers(stream):
    got = chained(
        stream(
            event(1, "pass", 0, player=1), event(2, "header", 1), event(3, "carry", 0, player=2), event(4, "pass", 1, player=9), event(5, "pass", 1, player=9, t=50),
            event(6, "take_on", 1, t=51), event(7, "pass", 0, t=52, outcome="incomplete", source="labelled"), event(8, "throw_in", 0, player=None, t=53), event(9, "shot", 0, player=4, t=54),
        )
    )
    assert (got[1].outcome, got[1].receiver_id) == ("complete", 2)  # a header is passed over
    assert (got[3].outcome, got[3].receiver_id) == ("incomplete", None)
    assert got[4].outcome == "unknown"  # too late
    assert got[6].outcome == "unknown" and got[6].outcome_source == "none"  # a take-on is never inferred
    assert got[7].outcome_source == "labelled" and got[7].outcome == "incomplete"
    assert (got[8].outcome, got[8].receiver_id) == ("complete", 4)
    assert got[2].outcome_source == "none"


def test_possession_changes_need_both_to_hold_the_ball(stream):
    df = chains.with_chains(stream(event(1, "pass", 0), event(2, "pass", 1), event(3, "tackle", 0, t=30), event(4, "pass", 1, t=31), event(5, "pass", 0, t=32)))
    found = chains.possession_changes(chains.chain_table(df)).collect()
    assert [(r.chain_id, r.gain.chain_id) for r in found] == [(0, 1), (3, 4)]


def test_passing_excludes_in_order_and_splits_pressure(stream):
    near, far = [(5100, 3400)], [(9000, 3400)]
    df = stream(
        event(1, "pass", 0, end=(6000.0, 3400.0), outcome="complete", opponents=near), event(2, "pass", 0, end=(5000.0, 4400.0), outcome="incomplete", opponents=far), event(3, "cross", 0, end=(4000.0, 3400.0), outcome="complete"),
        event(4, "pass", 0, player=None, outcome="unknown"), event(5, "pass", 0, player=None, outcome="complete"), event(6, "pass", 0, outcome="complete"), event(7, "carry", 0, end=(1.0, 1.0), outcome="complete"),
    )
    r = players.passing(df).first()
    assert (r.passes_attempted, r.passes_completed, r.passes_forward, r.passes_lateral, r.passes_back) == (3, 2, 1, 1, 1)
    assert (r.passes_under_pressure, r.passes_not_under_pressure, r.passes_pressure_unknown, r.passes_middle_third) == (1, 1, 1, 3)
    x = players.passing_exclusions(df).first()
    assert (x.excluded_unknown_outcome, x.skipped_no_actor, x.skipped_no_end) == (1, 1, 1)


def test_progression_bars_own_half_carries_and_deep_passes(stream):
    done = {"outcome": "complete"}
    df = stream(
        event(1, "pass", 0, x=5000.0, end=(6000.0, 3400.0), **done), event(2, "pass", 0, x=4000.0, end=(6000.0, 3400.0), **done), event(3, "carry", 0, x=3000.0, end=(5000.0, 3400.0), **done),
        event(4, "carry", 0, x=8700.0, end=(8900.0, 3400.0), **done), event(5, "cross", 0, x=6900.0, end=(9000.0, 3400.0), **done), event(6, "pass", 0, x=5000.0, end=(6000.0, 3400.0), outcome="incomplete"), event(7, "tackle", 0, x=9000.0),
    )
    r = players.progression(df).first()
    assert (r.progressive_passes, r.progressive_carries, r.final_third_entries_pass, r.box_entries_pass, r.box_entries_cross, r.box_entries_carry, r.touches_in_opp_box) == (2, 1, 1, 1, 1, 1, 1)
    assert r.progressive_distance_cm == pytest.approx(1000 + 2000 + 2000 + 200 + 2100)
    x = players.progression_exclusions(df).first()
    assert (x.passes_excluded_defending_40pct, x.carries_excluded_own_half, x.excluded_incomplete) == (1, 1, 1)


def test_key_pass_skips_contests_and_own_carries(stream):
    df = chains.with_chains(
        stream(
            event(1, "pass", 0, player=1), event(2, "tackle", 1), event(3, "carry", 0, player=2), event(4, "shot", 0, player=2),
            event(5, "pass", 0, player=2, t=20), event(6, "shot", 0, player=2, t=21), event(7, "carry", 0, player=3, t=40), event(8, "shot", 0, player=2, t=41), event(9, "pass", 0, player=1, t=60), event(10, "shot", 0, player=None, t=61),
        )
    )
    got = players.key_passes(df).collect()
    assert [(r.pass_event_id, r.shot_event_id, r.passer_id, r.xa) for r in got] == [(1, 4, 1, None)]


def test_shot_creating_actions_stop_at_barriers_and_null_actors_take_a_place(stream):
    df = chains.with_chains(
        stream(
            event(1, "pass", 0, player=1), event(2, "throw_in", 0, player=2), event(3, "pass", 0, player=3), event(4, "shot", 0, player=4), event(5, "shot", 0, player=5),
            event(6, "pass", 0, player=6, t=30), event(7, "pass", 0, player=None, t=31), event(8, "carry", 0, player=7, t=32), event(9, "shot", 0, player=8, t=33),
        )
    )
    got = sorted((r.shot_event_id, r.order, r.action_event_id) for r in players.shot_creating_actions(df).collect())
    assert got == [(4, 1, 3), (4, 2, 2), (5, 1, 4), (9, 1, 8)]
    sheet = {r.player_id: r for r in players.creation(df).collect()}
    assert sheet[4].sca == 1 and sheet[4].gca is None and sheet[4].xa is None


def test_ground_and_aerial_duels(stream):
    df = stream(event(1, "pass", 0), event(2, "tackle", 1), event(3, "pass", 1), event(4, "block", 1), event(5, "header", 0, t=20), event(6, "header", 0, t=20.5), event(7, "header", 1, t=20.8), event(8, "pass", 0, t=21), event(9, "header", 1, t=23))
    ground = duels.ground_duels(df).collect()
    assert [(r.event_id, r.b_club, r.winner_club) for r in ground] == [(2, 0, 1)]  # the block is against the own club
    aerial = duels.aerial_duels(df).collect()
    assert [(r.event_id, r.other_event_id, r.winner_club) for r in aerial] == [(5, 7, 0)]
    counts = {r.club_id: r for r in duels.by_participant(duels.duels(df)).collect()}
    assert (counts[0].ground_duels, counts[0].ground_duels_won, counts[0].aerial_duels_won) == (1, 0, 1)


def test_take_ons_need_a_beaten_opponent(stream):
    df = stream(event(1, "carry", 0, x=5000.0, end=(5600.0, 3400.0), outcome="complete", opponents=[(5200, 3400), (5200, 4400), (4900, 3400)]), event(2, "carry", 0, x=5000.0, end=(5100.0, 3400.0), opponents=[(5200, 3400)]), event(3, "carry", 0))
    got = duels.take_ons(df).collect()
    assert [(r.event_id, r.beaten_opponents, r.completed) for r in got] == [(1, 1, True)]
    assert duels.take_on_rate(df).first().take_on_rate == pytest.approx(1 / 3, abs=1e-4)
    assert duels.take_on_rate(stream(event(1, "pass", 0))).first().take_on_rate is None


def test_recoveries_and_turnovers(stream):
    df = chains.with_chains(stream(event(1, "pass", 0, x=2000.0, end=(8000.0, 3400.0)), event(2, "tackle", 1), event(3, "pass", 1, x=3000.0)))
    got = {r.kind: r for r in duels.ball_events(df).collect()}
    assert (got["turnover"].event_id, got["turnover"].third) == (1, "final") and (got["recovery"].event_id, got["recovery"].third) == (3, "defensive")
    assert duels.ball_events(df, anchor="start").where("kind = 'turnover'").first().third == "defensive"
    with pytest.raises(ValueError):
        duels.ball_events(df, anchor="middle")


def test_ppda_turns_the_opponents_frame_and_pools_before_dividing(stream):
    df = stream(event(1, "pass", 0, x=3000.0), event(2, "pass", 0, x=8000.0), event(3, "tackle", 1, x=6000.0), event(4, "block", 1, x=1000.0), event(5, "pass", 0, x=1000.0, half=2), event(6, "tackle", 1, x=9000.0, half=2), event(7, "tackle", 1, x=9000.0, half=2))
    parts = teams.ppda_components(df)
    got = {(r.half, r.pressing_club): r for r in parts.where("zone = 'trainor'").collect()}
    assert (got[1, 1].opponent_passes, got[1, 1].defensive_actions) == (1, 1)
    pooled = {r.pressing_club: r for r in teams.ppda_pooled(parts.where("zone = 'trainor'")).collect()}
    assert pooled[1].ppda == pytest.approx(2 / 3, abs=1e-4) and pooled[0].ppda is None
    assert {r.ppda for r in teams.ppda_team_half(parts).collect()} == {None}


def test_field_tilt_is_null_without_touches(stream):
    got = teams.field_tilt(stream(event(1, "pass", 0, x=1000.0), event(2, "pass", 1, x=1000.0))).collect()
    assert [(r.touches, r.field_tilt) for r in got] == [(0, None), (0, None)]


def test_keepers_conflict_and_shots_faced(stream):
    df = chains.with_chains(
        stream(
            event(1, "pass", 0, player=1, role=1, x=500.0, end=(3000.0, 3400.0)), event(2, "pass", 0, player=5), event(3, "shot", 1, player=9, x=9500.0), event(4, "carry", 1, player=11, role=1), event(5, "carry", 1, player=12, role=1),
            event(6, "shot", 0, player=5, x=9500.0, t=30),
        )
    )
    known = {r.club_id: r for r in teams.keepers(df).collect()}
    assert known[0].keeper_id == 1 and known[1].keeper_id is None and known[1].n_keepers == 2
    r = teams.keeper_sheet(df).first()
    assert (r.keeper_id, r.passes_completed, r.medium_attempted, r.shots_faced, r.saves) == (1, 1, 1, 1, None) and r.xg_faced > 0
    assert teams.unattributed_shots(df).first().unattributed == 1


def test_unlabelled_restarts_are_null_not_zero(stream):
    got = {r.restart: r for r in teams.restarts(stream(event(1, "throw_in", 0, outcome="complete"))).collect()}
    assert got["throw_in"].taken == 1 and got["corner"].taken is None and got["throw_in"].completion_rate is None


def test_corner_candidates_need_a_pause(stream):
    df = stream(event(1, "cross", 0, x=10400.0, y=50.0), event(2, "cross", 0, x=10400.0, y=50.0), event(3, "cross", 0, t=30, x=10400.0, y=6750.0), event(4, "cross", 0, t=60, x=9000.0, y=50.0))
    assert sorted(r.event_id for r in teams.corner_candidates(df).collect()) == [1, 3]
    assert 0 < teams.corner_null_test(df).first().p_value <= 1


def test_chain_types_and_causes(stream):
    rows = [event(1, "pass", 0, x=1000.0), event(2, "pass", 1, x=7500.0), event(3, "shot", 1, x=9800.0), event(4, "throw_in", 0, x=3000.0), event(5, "pass", 1, x=3000.0, t=40, end=(6000.0, 3400.0)), event(6, "pass", 0, x=3000.0, t=41, end=(5500.0, 3400.0)), event(7, "pass", 0, half=2, t=1)]
    got = {r.chain_id: r for r in sequences.classified(chains.with_chains(stream(*rows))).collect()}
    assert [(got[i].start_cause, got[i].end_cause) for i in range(6)] == [("half_start", "turnover"), ("regain", "shot"), ("restart", "gap"), ("gap", "turnover"), ("regain", "half_end"), ("half_start", "stream_end")]
    assert got[1].chain_type == "high_turnover" and got[4].chain_type == "counter_attack"
    counts = {r.chain_type: r.n_chains for r in sequences.type_counts(sequences.classified(chains.with_chains(stream(*rows)))).collect()}
    assert counts["build_up"] == 0 and counts["high_turnover"] == 1
    assert {r.conversion for r in sequences.conversion(sequences.classified(chains.with_chains(stream(*rows)))).collect()} == {None}
    with pytest.raises(ValueError):
        sequences.label(metric="sideways")


def test_xg_falls_with_distance_and_defaults_are_named(stream):
    df = chains.with_chains(stream(event(1, "throw_in", 0), event(2, "shot", 0, x=9400.0), event(3, "shot", 0, t=30, x=7000.0), event(4, "shot", 0, t=60, x=10500.0, opponents=[(10400, 3400), (10450, 3400), (5000, 100)])))
    got = {r.event_id: r for r in models.shots(df).collect()}
    assert got[2].xg > got[3].xg and got[2].origin is True and got[3].origin is None
    assert set(got[3].defaulted) == {"header", "set_piece", "lane"} and "x_m" in got[4].defaulted
    z = 0.5103 + 0.6338 * 2 * math.atan(3.66 / 35) - 0.2798 * 35 + 0.1243 * 35 + 0.0014 * 35**2 - 0.1251 * 2 * math.atan(3.66 / 35) * 35
    assert got[3].xg == pytest.approx(1 / (1 + math.exp(-z)))


def test_defenders_in_lane(stream):
    from pyspark.sql import functions as F

    df = stream(event(1, "shot", 0, x=9500.0, opponents=[(10000, 3400), (10000, 5000), (9000, 3400), (9500, 3400)]), event(2, "shot", 0))
    got = [r[0] for r in df.orderBy("event_id").select(G.in_lane(F.col("x"), F.col("y"), F.col("opponents"))).collect()]
    assert got == [2, None]


def test_midrank(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 9.0), (2, 5.0)], "g int, v double")
    assert sorted(r.percentile for r in models.midrank(df, "v", ["g"]).where("g = 1").collect()) == [0, 50, 50, 100]
    assert models.midrank(df, "v", ["g"]).where("g = 2").first().percentile == 50


def test_threat_is_a_fixed_point_and_bounded(stream):
    rows = []
    for k in range(60):
        rows += [event(10 * k + 1, "pass", 0, t=100 * k, x=3000.0 + 50 * k, end=(8000.0, 3000.0)), event(10 * k + 2, "carry", 0, t=100 * k + 1, x=8000.0, y=3000.0, end=(9800.0, 3400.0)), event(10 * k + 3, "shot" if k % 2 else "pass", k % 3 and 0 or 0, t=100 * k + 2, x=9800.0, end=(9900.0, 3400.0))]
    df = chains.with_chains(stream(*rows)).cache()
    fit = models.fit_threat(df)
    assert fit.converged and (fit.value >= 0).all() and fit.value.max() <= fit.shot_value.max() + 1e-9 and ((fit.shot_share >= 0) & (fit.shot_share <= 1)).all()
    credits = models.credit_moves(df, fit)
    by = models.threat_by_player(credits).first()
    assert by.n_rated + by.n_failed == credits.where("player_id is not null").count()
    top = models.top_actions(credits, 3).collect()
    assert len(top) == 3 and top[0].worth >= top[-1].worth


def test_momentum_is_antisymmetric_and_dense(spark):
    rows = [(1, 1, 30.0, 0, 0.05), (1, 1, 40.0, 0, 0.5), (1, 1, 250.0, 1, 0.02), (1, 2, 10.0, 1, -0.1)]
    df = spark.createDataFrame(rows, "match_id long, half int, t double, club_id long, delta double")
    got = {(r.half, r.minute, r.club_id): r for r in models.momentum(df).collect()}
    assert len(got) == 2 * (5 + 1)
    for (half, minute, club), r in got.items():
        assert r.value == pytest.approx(-got[half, minute, 1 - club].value)
    assert got[1, 0.0, 0].value == pytest.approx(0.1)  # the cap
    assert got[1, 1.0, 0].value == pytest.approx(0.1 * 0.5 / 1.5)

"""The sweep of statistics under event loss, as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_match_statistics import SCHEMA, event
from touchline.operators import chains, duels, models, players, robustness
from touchline.plans import registry

COUNTS = {"passes_attempted", "progressive_actions", "key_passes", "sca", "touches_in_opp_box", "final_third_entries", "recoveries", "shots"}
STATS = {f"count_{x}" for x in COUNTS} | {"total_xg", "ratio_pass_completion", "ratio_progressive_share", "ratio_field_tilt_box_share"}
KINDS = ["pass", "carry", "tackle", "pass", "cross", "shot", "throw_in"]


def stream(spark, n=160):
    def one(i):
        x, y = 3000.0 + i * 977 % 7400, 500.0 + i * 613 % 6000
        return event(i, KINDS[i % 7], i // 5 % 2, player=None if i % 19 == 0 else i % 6, x=x, y=y, end=None if i % 7 == 5 else (min(10400.0, x + i * 389 % 3000), y), match=i % 2, replay=i % 23 == 0, opponents=[(9000, 3400)] * (i % 4))

    return spark.createDataFrame([one(i) for i in range(n)], SCHEMA)


def by_hand(events):
    """The same figures from the sheets of one scenario's events alone."""
    ch = chains.with_chains(events).cache()
    rows = [r.asDict() for r in players.tier_one(ch, models.shots).collect()]
    total = lambda *names: float(sum(r[n] for r in rows for n in names))
    passes, boxes, moves = total("passes_attempted"), total("touches_in_opp_box"), total("progressive_passes", "progressive_carries")
    return {
        "count_passes_attempted": passes, "count_progressive_actions": moves, "count_key_passes": total("key_passes"), "count_sca": total("sca"), "count_touches_in_opp_box": boxes,
        "count_final_third_entries": total("final_third_entries_pass", "final_third_entries_carry"), "count_recoveries": float(duels.ball_events(ch).where("kind = 'recovery' and player_id is not null").count()),
        "count_shots": total("shots"), "total_xg": total("xg"), "ratio_pass_completion": total("passes_completed") / passes if passes else 0.0, "ratio_progressive_share": moves / passes if passes else 0.0, "ratio_field_tilt_box_share": boxes / ch.count(),
    }


def test_statistics_are_rebuilt_in_each_scenario(spark):
    df = stream(spark)
    kept = robustness.scenarios(df, rates=(0.4,), trials=2).cache()
    got = robustness.statistics(kept, ("model", "rate", "trial")).collect()
    for model in ("uniform", "crowd-biased"):
        want = by_hand(kept.where((F.col("model") == model) & (F.col("trial") == 2)).drop("model", "rate", "trial"))
        assert {r.stat: r.value for r in got if r.model == model and r.trial == 2} == pytest.approx(want, abs=1e-4)
    whole = {r.stat: r.value for r in robustness.statistics(df).collect()}
    assert whole == pytest.approx(by_hand(df), abs=1e-4) and all(whole.values())


def test_loss_keeps_its_rate_below_three_tenths(spark):
    crowds = [0] * 3000 + [8] * 300 + [60] * 150
    df = spark.createDataFrame([event(i, "pass", 0, opponents=[(5000, 3400)] * c) for i, c in enumerate(crowds)], SCHEMA)
    kept = robustness.scenarios(df, rates=(0.2,), models=("crowd-biased",), trials=4).count()
    assert kept / 4 == pytest.approx(0.8 * len(crowds), abs=40)


def test_a_scenario_without_events_counts_zero(spark):
    df = spark.createDataFrame([event(1, "shot", 0)], SCHEMA)
    rows = robustness.sweep(df, robustness.statistics, rates=(0.4,), trials=20).where("stat = 'count_shots'").collect()
    assert [r.n_trials for r in rows] == [20, 20] and all(0 < r.mean_value < 1 for r in rows)


def test_the_registered_sweep_is_whole(spark):
    rows = registry.QUERIES["sensitivity_sweep"](spark, "/root/testdata/sf0.001").collect()
    assert {r.stat for r in rows} == STATS and {r.rate for r in rows} == {0.05, 0.1, 0.2, 0.4} and {r.n_trials for r in rows} == {20} and len(rows) == 96


def test_batches_hold_each_scenario_once_and_find_the_same(spark, monkeypatch):
    df = stream(spark, 40)
    arguments = {"rates": (0.2, 0.4), "models": ("uniform",), "trials": 3}
    whole = robustness.sweep(df, robustness.statistics, **arguments).collect()
    asked = []
    monkeypatch.setattr(robustness, "scenarios", lambda *a, f=robustness.scenarios, **k: asked.append(k["only"]) or f(*a, **k))
    monkeypatch.setattr(robustness, "MOST_ROWS", 80)
    assert sorted(map(str, robustness.sweep(df, robustness.statistics, **arguments).collect())) == sorted(map(str, whole))
    assert asked == [([("uniform", 0.2)], [1, 2]), ([("uniform", 0.2)], [3]), ([("uniform", 0.4)], [1, 2]), ([("uniform", 0.4)], [3])]
    for n in (0, 1, 5000, 30_000, 50_000_000):
        assert sorted((m, r, t) for pairs, trials in robustness.batches(n, robustness.RATES, robustness.MODELS, 20) for m, r in pairs for t in trials) == sorted((m, r, t) for m in robustness.MODELS for r in robustness.RATES for t in range(1, 21))


def odd_stream(spark, n=420):
    """Events with every kind of gap: null clubs, players, halves, times, ends, kinds, outcomes, ids and matches; labels, headers, runs of carries, an empty and a one-event match."""
    pick = random.Random(5)
    kinds = ["pass", "carry", "carry", "shot", "cross", "tackle", "header", "throw_in", "take_on", "foul_won", "corner", None]
    maybe = lambda v, p=0.06: None if pick.random() < p else v
    rows = []
    for i in range(n):
        place, end = (pick.uniform(4000, 10500), pick.uniform(0, 6800)), (pick.uniform(4000, 10500), pick.uniform(0, 6800))
        source = pick.choice(["none", "none", "none", "labelled", None])
        row = list(event(i, pick.choice(kinds), pick.choice([0, 0, 0, 1]), t=i * 0.7 + (i // 40) * 12, x=place[0], y=place[1], end=maybe(end, 0.2), half=1 + i // 50 % 2, match=maybe(i // 130, 0.04), source=source or "none", outcome=pick.choice(["complete", "incomplete", "unknown"]), replay=maybe(i % 31 == 0, 0.02), opponents=[(9500, 3000 + 100 * j) for j in range(i % 4)]))
        row[0] = -7 if i == n - 1 else row[0]
        row[6] = maybe(pick.choice([1, 1, 2, 3]), 0.15)
        for c, p in ((1, 0.04), (2, 0.02), (3, 0.0), (4, 0.05), (7, 0.08), (9, 0.02), (13, 0.05), (16, 0.01)):
            row[c] = maybe(row[c], p)
        row[14] = source
        rows.append((*row, pick.choice([True, False, None])))
    return spark.createDataFrame(rows, SCHEMA + ", is_header boolean")


def tuples(moves):
    return sorted((r.stat, r.model, r.rate, r.n_trials, *(None if v is None else round(v, 6) for v in (r.base, r.mean_value, r.mean_relative_movement, r.std_relative_movement, r.mean_absolute_movement))) for r in moves.collect())


@pytest.mark.parametrize("make", [stream, odd_stream])
def test_the_sheets_sweep_finds_what_the_sweep_of_statistics_does(spark, make):
    df, arguments = make(spark).cache(), {"rates": (0.1, 0.4), "trials": 6, "seed": 3}
    want = tuples(robustness.sweep(df, robustness.statistics, **arguments))
    assert tuples(robustness.sheet_sweep(df, **arguments)) == want and sum(row[4] > 0 for row in want) == len(want)


def test_the_sheets_sweep_of_nothing_and_of_other_ids(spark):
    df = stream(spark, 60).cache()
    arguments = {"rates": (0.4,), "models": ("uniform",), "trials": 2}
    empty = robustness.sheet_sweep(df.where("false"), **arguments).collect()
    assert {r.stat for r in empty} == STATS and all((r.base, r.n_trials, r.mean_value, r.mean_absolute_movement) == (0, 2, 0, 0) for r in empty)
    named = df.withColumn("match_id", F.concat(F.lit("m"), "match_id"))
    assert tuples(robustness.sheet_sweep(named, **arguments)) == tuples(robustness.sweep(named, robustness.statistics, **arguments))


@pytest.mark.parametrize("name", ["sensitivity_sweep", "sensitivity_gating"])
def test_the_registered_sweeps_make_no_row_for_an_event_and_a_scenario(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("scenarios as rows")

    monkeypatch.setattr(robustness, "scenarios", refuse)
    assert {r.stat for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()} == STATS

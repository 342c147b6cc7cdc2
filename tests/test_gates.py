"""The four gates of a pair of tracklets."""

from pyspark.sql import functions as F

from touchline.operators import pairs
from touchline.plans import registry


def test_only_trusted_teams_forbid(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0.9, 0.4), (2, 0, 1, 0.9, 0.5), (3, 0, 1, None, 0.9), (4, 0, 0, 0.9, 0.9), (5, None, 1, 0.9, 0.9)], "i int, a_team int, b_team int, a_confidence double, b_confidence double")
    got = {r.i: r.reason for r in pairs.gated(rows, [pairs.team_reason(0.5)]).collect()}
    assert {i for i, reason in got.items() if reason == "team_mismatch"} == {2, 3}


def test_motion_by_pitch_camera_or_pixels(spark):
    one, wide, shift = ([[k, 0.0, d], [0.0, k, 0.0], [0.0, 0.0, 1.0]] for k, d in ((1.0, 0.0), (10.0, 0.0), (1.0, 900.0)))
    # One second from x = 0 to x = 850: too fast for 800 pixels/s, not for 900 cm/s.
    data = [(1, 25, 850.0, None, None, None), (2, 25, 850.0, one, one, None), (3, 25, 100.0, wide, wide, None), (4, 25, 850.0, one, None, None), (5, 25, 850.0, None, None, shift), (6, 25, 100.0, None, None, shift), (7, 0, 850.0, one, one, None), (8, 400, 1e6, one, one, None)]
    rows = spark.createDataFrame([(i, 0, g, 0.0, 0.0, x, 0.0, a, b, c) for i, g, x, a, b, c in data], "i int, a_end int, b_start int, a_end_x double, a_end_y double, b_start_x double, b_start_y double, a_h array<array<double>>, b_h array<array<double>>, camera array<array<double>>")
    gate = pairs.motion_reason(calibration=(F.col("a_h"), F.col("b_h")), camera=F.col("camera"))
    assert {r.i for r in pairs.gated(rows, [gate]).collect() if r.reason} == {1, 3, 4}


def test_all_four_gates_are_registered(spark):
    reasons = {r.reason for r in registry.QUERIES["four_gates"](spark, "/root/testdata/sf0.001").collect()}
    assert reasons == {None, "temporal_overlap", "team_mismatch", "anchor_conflict", "motion_infeasible"}

"""How often the registered queries draw anew."""

from pyspark.sql import functions as F

from tests.test_match_statistics import SCHEMA, event
from touchline.operators import association, formation, teams


def test_corner_null_test_deals_two_thousand_times(spark):
    """Every shuffle has as many as observed in one half's only cross, or p would be one of 2001 values above 1/2001."""
    df = spark.createDataFrame([event(1, "cross", 0, t=0, x=10500.0, y=0.0), *(event(i, "cross", 0, t=100 + i, x=6000.0) for i in range(2, 40))], SCHEMA)
    p = teams.corner_null_test(df).first().p_value
    assert abs(p * 2001 - round(p * 2001)) < 1e-9 and 0 < p < 0.1 and abs(p * 201 - round(p * 201)) > 1e-6


def test_corner_null_test_deals_by_spark_s_own_hash_without_a_row_for_each_deal(spark):
    """Halves are dealt in the order of xxhash64(seed, shuffle, event_id), each as a whole."""
    rows = [event(i, "cross", 0, t=i * i, half=1 + i % 2, match=i % 3, x=10400.0 if i % 4 else 6000.0, y=i * 611.0 % 3400) for i in range(1, 90)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = teams.corner_null_test(df, radius=2000.0, min_gap=500.0, permutations=40, seed=3)
    crosses = [r.asDict() for r in teams._crosses(df, teams.G.FIFA).collect()]
    hashes = spark.range(1, 41).select(F.col("id").cast("int").alias("trial")).crossJoin(df.select("event_id")).select("trial", "event_id", F.xxhash64(F.lit(3), "trial", "event_id").alias("h")).collect()
    hashes = {(r.trial, r.event_id): r.h for r in hashes}
    late = lambda r: r["gap"] > 500
    found = {name: [0] * 41 for name in ("flag_distance", "line_distance")}
    for half in {(r["match_id"], r["half"]) for r in crosses}:
        own = sorted((r for r in crosses if (r["match_id"], r["half"]) == half), key=lambda r: r["event_id"])
        for trial in range(41):
            dealt = sorted(own, key=lambda r, t=trial: hashes[t, r["event_id"]]) if trial else own
            for name, counts in found.items():
                counts[trial] += sum(late(r) and d[name] <= 2000 for r, d in zip(own, dealt, strict=True))
    p = {name: (1 + sum(c >= counts[0] for c in counts[1:])) / 41 for name, counts in found.items()}
    row = got.first()
    assert (row.p_value, row.baseline_p) == (p["flag_distance"], p["line_distance"]) and 0 < row.p_value < 1 and row.observed == found["flag_distance"][0]
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_defaults_are_those_of_the_reference():
    import inspect

    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert default(teams.corner_null_test, "permutations") == 2000
    assert default(formation.attack_direction, "permutations") == 400
    assert default(association.bootstrap_delta, "draws") == 1000

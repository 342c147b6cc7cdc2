"""Per-player counts of one match and half: passing, progression, creation. Input: chained events.

Unknown outcomes leave both numerator and denominator; what a rule cannot see stays null, never 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators.chains import ORDER, is_contest
from touchline.sources.matches import CREATING_TYPES

PLAYER = ["match_id", "half", "player_id", "club_id"]


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def pass_attempts(events: DataFrame) -> DataFrame:
    """Passes and crosses with `excluded`: the first reason, in the order outcome, actor, end, or null."""
    reason = F.when(F.col("outcome") == "unknown", "unknown_outcome").when(F.col("player_id").isNull(), "no_actor").when(F.col("end_x").isNull(), "no_end")
    return events.where(F.col("type").isin("pass", "cross")).withColumn("excluded", reason)


def passing(events: DataFrame, pitch: G.Pitch = G.FIFA, radius: float = G.PRESSURE_RADIUS) -> DataFrame:
    """Attempts and completions per player in all, by direction, by third of origin and by pressure (yes, no, unknown)."""
    rows = pass_attempts(events).where("excluded is null")
    rows = rows.withColumns(
        {
            "direction": G.direction(F.col("x"), F.col("y"), F.col("end_x"), F.col("end_y")),
            "third": G.third(F.col("x"), pitch),
            "pressed": G.under_pressure(F.col("x"), F.col("y"), F.col("opponents"), radius),
        }
    )
    done = F.col("outcome") == "complete"
    splits = {"": F.lit(True)}
    splits |= {f"_{d}": F.col("direction") == d for d in ("forward", "lateral", "back")}
    splits |= {f"_{t}_third": F.col("third") == t for t in ("defensive", "middle", "final")}
    splits |= {"_under_pressure": F.col("pressed"), "_not_under_pressure": ~F.col("pressed"), "_pressure_unknown": F.col("pressed").isNull()}
    columns = []
    for name, condition in splits.items():
        columns += [_n(condition).alias(f"passes{name or '_attempted'}"), _n(condition & done).alias(f"passes{name}_completed")]
    return rows.groupBy(*PLAYER).agg(*columns)


def pass_completion(events: DataFrame) -> DataFrame:
    """Attempts, completions and their rate per match and player, with chain-inferred outcomes."""
    rows = pass_attempts(events).where("excluded is null")
    done = _n(F.col("outcome") == "complete")
    return rows.groupBy("match_id", "player_id").agg(F.count("*").alias("attempted"), done.alias("completed"), F.round(done / F.count("*"), 4).alias("completion_rate"))


def passing_exclusions(events: DataFrame) -> DataFrame:
    """Per match and half, what passing() left out and why."""
    rows = pass_attempts(events)
    names = {"unknown_outcome": "excluded_unknown_outcome", "no_actor": "skipped_no_actor", "no_end": "skipped_no_end"}
    pressed = F.col("excluded").isNull() & (F.size("opponents") == 0)
    return rows.groupBy("match_id", "half").agg(*(_n(F.col("excluded") == k).alias(v) for k, v in names.items()), _n(pressed).alias("pressure_unknown"))


def is_progressive(pitch: G.Pitch = G.FIFA, gain: float = G.PROGRESSIVE_GAIN) -> Column:
    """Null without an end; barred for carries that end in the own half and other moves from the own 40 %; into the box always."""
    x, y, ex, ey = (F.col(c) for c in ("x", "y", "end_x", "end_y"))
    carry = F.col("type") == "carry"
    barred = F.when(carry, G.in_defending(ex, 0.5, pitch)).otherwise(G.in_defending(x, 0.4, pitch))
    return F.when(ex.isNotNull(), F.when(barred, False).when(G.in_box(ex, ey, pitch), True).otherwise(G.progression(x, y, ex, ey, pitch) >= gain))


def progression(events: DataFrame, pitch: G.Pitch = G.FIFA, gain: float = G.PROGRESSIVE_GAIN) -> DataFrame:
    """Progressive passes, carries and distance, entries into final third and box by completed moves, touches in the box."""
    x, y, ex, ey = (F.col(c) for c in ("x", "y", "end_x", "end_y"))
    a_pass, carry = F.col("type").isin("pass", "cross"), F.col("type") == "carry"
    rows = events.where("player_id is not null")
    rows = rows.withColumns(
        {
            "move": (a_pass | carry) & ex.isNotNull() & (F.col("outcome") == "complete"),
            "gained": G.progression(x, y, ex, ey, pitch),
            "progressive": is_progressive(pitch, gain),
            "enters_third": ~G.in_final_third(x, pitch) & G.in_final_third(ex, pitch),
            "enters_box": ~G.in_box(x, y, pitch) & G.in_box(ex, ey, pitch),
            "in_box": G.in_box(x, y, pitch),
        }
    )
    move, gained = F.col("move"), F.greatest(F.col("gained"), F.lit(0.0))
    far = lambda which: F.round(F.coalesce(F.sum(F.when(move & which, gained)), F.lit(0.0)), 3)
    out = rows.groupBy(*PLAYER).agg(
        _n(move & a_pass & F.col("progressive")).alias("progressive_passes"),
        _n(move & carry & F.col("progressive")).alias("progressive_carries"),
        far(F.lit(True)).alias("progressive_distance_cm"),
        far(a_pass).alias("progressive_passing_distance_cm"),
        far(carry).alias("progressive_carrying_distance_cm"),
        _n(move & a_pass & F.col("enters_third")).alias("final_third_entries_pass"),
        _n(move & carry & F.col("enters_third")).alias("final_third_entries_carry"),
        _n(move & a_pass & F.col("enters_box")).alias("box_entries_pass"),
        _n(move & (F.col("type") == "pass") & F.col("enters_box")).alias("box_entries_open_pass"),
        _n(move & (F.col("type") == "cross") & F.col("enters_box")).alias("box_entries_cross"),
        _n(move & carry & F.col("enters_box")).alias("box_entries_carry"),
        _n(F.col("in_box")).alias("touches_in_opp_box"),
        _n(move).alias("_moves"),
    )
    return out.where("_moves > 0 or touches_in_opp_box > 0").drop("_moves")


def progression_exclusions(events: DataFrame, pitch: G.Pitch = G.FIFA, gain: float = G.PROGRESSIVE_GAIN) -> DataFrame:
    """Per match and half, what progression() left out, checked in the order actor, end, outcome."""
    x, ex = F.col("x"), F.col("end_x")
    moving = F.col("type").isin("pass", "cross", "carry")
    actor = F.col("player_id").isNotNull()
    whole = moving & actor & ex.isNotNull()
    gained = G.progression(x, F.col("y"), ex, F.col("end_y"), pitch) >= gain
    done = whole & (F.col("outcome") == "complete") & gained
    barred_pass = done & F.col("type").isin("pass", "cross") & G.in_defending(x, 0.4, pitch)
    barred_carry = done & (F.col("type") == "carry") & G.in_defending(ex, 0.5, pitch)
    return events.groupBy("match_id", "half").agg(
        _n(~actor).alias("skipped_no_actor"),
        _n(moving & actor & ex.isNull()).alias("skipped_no_end"),
        _n(whole & (F.col("outcome") == "incomplete")).alias("excluded_incomplete"),
        _n(whole & (F.col("outcome") == "unknown")).alias("abstained_unknown_outcome"),
        _n(barred_pass).alias("passes_excluded_defending_40pct"),
        _n(barred_carry).alias("carries_excluded_own_half"),
    )


def _before_shots(chained: DataFrame) -> DataFrame:
    """Every shot with every earlier event of its chain."""
    spot = F.struct(*ORDER)
    shots = chained.where("type = 'shot'").select("match_id", "chain_id", F.col("event_id").alias("shot_event_id"), F.col("club_id").alias("shot_club"), F.col("player_id").alias("shooter_id"), spot.alias("shot_at"))
    earlier = chained.select("match_id", "chain_id", "event_id", "type", "club_id", "player_id", spot.alias("at"))
    return earlier.join(shots, ["match_id", "chain_id"]).where("at < shot_at")


def key_passes(chained: DataFrame, shot_value: DataFrame | None = None) -> DataFrame:
    """The pass or cross that made each shot: the last earlier event of the chain, contests and the shooter's own carries skipped,
    if it is one by another known player of the shooter's club. A shot without an actor has none. xa is the shot's value
    (shot_value: match_id, event_id, xg), null without a model.
    """
    rows = _before_shots(chained).where("shooter_id is not null")
    own_carry = (F.col("type") == "carry") & (F.col("club_id") == F.col("shot_club")) & F.col("player_id").eqNullSafe(F.col("shooter_id"))
    last = Window.partitionBy("match_id", "shot_event_id").orderBy(F.col("at").desc())
    rows = rows.where(~is_contest() & ~own_carry).withColumn("rank", F.row_number().over(last)).where("rank = 1")
    credited = (F.col("club_id") == F.col("shot_club")) & F.col("type").isin("pass", "cross") & (F.col("player_id") != F.col("shooter_id"))
    rows = rows.where(credited).select("match_id", "chain_id", F.col("event_id").alias("pass_event_id"), "shot_event_id", "club_id", F.col("player_id").alias("passer_id"), "shooter_id")
    if shot_value is None:
        return rows.withColumn("xa", F.lit(None).cast("double"))
    value = shot_value.select("match_id", F.col("event_id").alias("shot_event_id"), F.col("xg").alias("xa"))
    return rows.join(value, ["match_id", "shot_event_id"], "left")


def shot_creating_actions(chained: DataFrame, window: int = 2) -> DataFrame:
    """Up to `window` eligible actions of the shooter's club before each shot, the nearest first; an earlier shot or throw-in ends the walk.

    An action without an actor takes its place and earns nothing.
    """
    rows = _before_shots(chained).where((F.col("club_id") == F.col("shot_club")) & F.col("type").isin(CREATING_TYPES))
    back = Window.partitionBy("match_id", "shot_event_id").orderBy(F.col("at").desc())
    ends = F.col("type").isin("shot", "throw_in").cast("int")
    rows = rows.withColumns({"order": F.row_number().over(back), "_ended": F.coalesce(F.sum(ends).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.where(F.col("order").between(1, window) & (F.col("_ended") == 0) & F.col("player_id").isNotNull())
    return rows.select("match_id", "chain_id", F.col("event_id").alias("action_event_id"), "shot_event_id", "club_id", "player_id", F.col("type").alias("action_type"), "order")


def creation(chained: DataFrame, shot_value: DataFrame | None = None, goals: DataFrame | None = None) -> DataFrame:
    """Key passes, xA, SCA and GCA per match and player. xa is null without a value model and gca without goals (match_id, event_id), else 0 where there are none."""
    passes = key_passes(chained, shot_value).select("match_id", F.col("passer_id").alias("player_id"), "club_id", F.lit(1).alias("kp"), "xa", F.lit(0).alias("sca"), F.lit(0).alias("gca"))
    actions = shot_creating_actions(chained)
    if goals is not None:
        actions = actions.join(goals.select("match_id", F.col("event_id").alias("shot_event_id"), F.lit(1).alias("goal")), ["match_id", "shot_event_id"], "left")
    else:
        actions = actions.withColumn("goal", F.lit(None).cast("int"))
    actions = actions.select("match_id", "player_id", "club_id", F.lit(0).alias("kp"), F.lit(None).cast("double").alias("xa"), F.lit(1).alias("sca"), F.coalesce("goal", F.lit(0)).alias("gca"))
    xa = F.coalesce(F.round(F.sum("xa"), 6), F.lit(0.0)) if shot_value is not None else F.lit(None).cast("double")
    gca = F.sum("gca") if goals is not None else F.lit(None).cast("long")
    return passes.unionByName(actions).groupBy("match_id", "player_id", "club_id").agg(F.sum("kp").alias("key_passes"), xa.alias("xa"), F.sum("sca").alias("sca"), gca.alias("gca"))


def sca_by_club(chained: DataFrame) -> DataFrame:
    return shot_creating_actions(chained).groupBy("match_id", "club_id").agg(F.count("*").alias("sca"))


def coverage(positions: DataFrame) -> DataFrame:
    """Per player the frames in which it is seen, over all frames of the clip. positions: clip, frame, player_id, seen (boolean)."""
    total = positions.groupBy("clip").agg(F.countDistinct("frame").alias("total_frames"))
    own = positions.groupBy("clip", "player_id").agg(F.count(F.when(F.col("seen"), 1)).alias("observed_frames"))
    return own.join(total, "clip").withColumn("observed_fraction", F.round(F.col("observed_frames") / F.col("total_frames"), 4))


def class_counts(actions: DataFrame) -> DataFrame:
    """Actions per class and slot, and how many have a box."""
    return actions.groupBy("class_id", "slot").agg(F.count("*").alias("n"), F.count(F.when(F.col("has_box"), 1)).alias("with_box"))


def _creation_by_half(chained: DataFrame, shot_value: DataFrame) -> DataFrame:
    """creation() with the half of the credited action; gca stays null without goals."""
    halves = chained.select("match_id", "event_id", "half")
    passes = key_passes(chained, shot_value).withColumnRenamed("pass_event_id", "event_id").join(halves, ["match_id", "event_id"])
    passes = passes.select("match_id", "half", F.col("passer_id").alias("player_id"), "club_id", F.lit(1).alias("kp"), F.col("xa"), F.lit(0).alias("sca"))
    actions = shot_creating_actions(chained).withColumnRenamed("action_event_id", "event_id").join(halves, ["match_id", "event_id"])
    actions = actions.select("match_id", "half", "player_id", "club_id", F.lit(0).alias("kp"), F.lit(0.0).alias("xa"), F.lit(1).alias("sca"))
    return passes.unionByName(actions).groupBy(*PLAYER).agg(F.sum("kp").alias("key_passes"), F.round(F.sum("xa"), 6).alias("xa"), F.sum("sca").alias("sca"))


def tier_one(chained: DataFrame, value: Callable[[DataFrame], DataFrame], pitch: G.Pitch = G.FIFA) -> DataFrame:
    """One wide row per match, half and player that any of the parts knows: shots and xG, passing, progression, creation, take-ons, duels, balls won and lost.

    Counters are 0 where a part knows nothing of a player; gca is null, as there are no goal labels.
    """
    from touchline.operators import duels

    valued = value(chained)
    shots = valued.where("player_id is not null").groupBy(*PLAYER).agg(F.count("*").alias("shots"), F.round(F.sum("xg"), 6).alias("xg"))
    parts = [shots, passing(chained, pitch), progression(chained, pitch), _creation_by_half(chained, valued), duels.take_ons_by_player(chained), duels.duels_by_player(chained), duels.balls_by_player(chained, pitch)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    counts = [c for c in out.columns if c not in PLAYER]
    # A part has one row a player at most, and no column of another part: all meet in one shuffle.
    return out.groupBy(*PLAYER).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts), F.lit(None).cast("long").alias("gca"))


def headline(sheet: DataFrame) -> DataFrame:
    """The columns that may stand in a headline table: no unvalidated detector among them."""
    return sheet.drop("take_ons", "take_ons_completed", "gca")


def abstentions(chained: DataFrame, pitch: G.Pitch = G.FIFA) -> DataFrame:
    """Per match and half, everything that the sheet left out, by reason."""
    return passing_exclusions(chained).join(progression_exclusions(chained, pitch).withColumnsRenamed({"skipped_no_actor": "moves_no_actor", "skipped_no_end": "moves_no_end"}), ["match_id", "half"], "full_outer")

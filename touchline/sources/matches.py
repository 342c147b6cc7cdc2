"""Match events from the driver's tables: a deterministic projection in integer arithmetic.

Columns of the stream that all statistics read: match_id, half, event_id, frame_idx, t, type, player_id, club_id, role, x, y, end_x, end_y,
outcome, outcome_source, replay, opponents, teammates. A day is a match, numbered from 1970-01-01, noon its half time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The event vocabulary and its classes.
POSSESSION_TYPES = ["pass", "cross", "carry", "shot", "throw_in", "take_on"]
CONTEST_TYPES = ["tackle", "block", "header"]
MOVE_TYPES = ["pass", "cross", "carry", "throw_in"]
RESTART_TYPES = ["corner", "free_kick", "goal_kick", "penalty", "throw_in"]
CREATING_TYPES = ["pass", "cross", "carry", "take_on", "foul_won", "shot", "throw_in"]

#: Seconds of silence that end a chain. The published value is 10 s; the driver's events are minutes apart.
MAX_GAP = 10.0
DRIVER_GAP = 600.0

_LOOKUP = ["pass", "pass", "carry", "pass", "cross", "shot", "header", "tackle", "carry", "block", "throw_in", "pass"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _around(name: str, seed: int, n: int) -> Column:
    """n points within 900 cm of an event, from its id."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), n)),
        lambda j: F.struct(
            (F.col("x") + (F.col("event_id") * 17 + j * (seed + 36)) % 1801 - 900).cast("double").alias("x"),
            (F.col("y") + (F.col("event_id") * 29 + j * (seed + 52)) % 1801 - 900).cast("double").alias("y"),
        ),
    )


def match_events(spark: SparkSession, sf_dir: str, max_gap: float = DRIVER_GAP) -> DataFrame:
    """The match event stream of a driver's folder."""
    k = F.get_json_object("props", "$.k").cast("long")
    days = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    t = days * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")  # whole seconds, whatever the session's zone
    rows = table(spark, sf_dir, "events").select(
        days.alias("match_id"),
        (F.hour("ts") / 12).cast("int").alias("_late"),
        F.col("event_id").cast("long"),
        t.alias("frame_idx"),
        t.cast("double").alias("t"),
        F.element_at(F.array(*map(F.lit, _LOOKUP)), ((F.col("event_id") * 7 + k) % 12 + 1).cast("int")).alias("type"),
        F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("player_id"),
        (F.col("user_id") % 2).alias("club_id"),
        F.when(F.col("user_id") < 2, 1).otherwise((F.col("user_id") % 10 + 2).cast("int")).alias("role"),
        ((k * 97 + F.col("event_id") * 131) % 10501).alias("x"),
        ((k * 53 + F.col("event_id") * 71) % 6801).alias("y"),
        (F.col("event_id") % 29 == 0).alias("replay"),
    )
    rows = rows.withColumn("half", F.col("_late") + 1).drop("_late")
    n = (F.col("event_id") % 4).cast("int")
    none = F.array().cast("array<struct<x:double,y:double>>")
    rows = rows.withColumns({"opponents": F.when(n > 0, _around("o", 1, n)).otherwise(none), "teammates": F.when(n > 1, _around("m", 5, n)).otherwise(none)})
    rows = rows.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    rows = rows.withColumns({"outcome": F.lit("unknown"), "outcome_source": F.lit("none")})
    return with_ends(rows, max_gap)


def with_ends(events: DataFrame, max_gap: float = MAX_GAP, length: float = 10500.0, width: float = 6800.0) -> DataFrame:
    """Adds end_x, end_y: where the next event of the same replay status begins, in the acting club's frame.

    Null for shots, for the last event of a half and after more than max_gap seconds.
    """
    order = Window.partitionBy("match_id", "half", "replay").orderBy("frame_idx", "event_id")
    events = events.withColumn("_next", F.lead(F.struct("t", "x", "y", "club_id")).over(order))
    known = (F.col("type") != "shot") & (F.col("_next.t") - F.col("t") <= max_gap)
    same = F.col("_next.club_id") == F.col("club_id")
    end_x = F.when(same, F.col("_next.x")).otherwise(length - F.col("_next.x"))
    end_y = F.when(same, F.col("_next.y")).otherwise(width - F.col("_next.y"))
    return events.withColumns({"end_x": F.when(known, end_x), "end_y": F.when(known, end_y)}).drop("_next")

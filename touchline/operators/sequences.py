"""Chains by how they begin, end and attack. Input: chained events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators.chains import ORDER, chain_table
from touchline.operators.teams import LEAST_DENOMINATOR, share
from touchline.sources.matches import MAX_GAP

# The labels, the strongest first.
TYPES = ["high_turnover", "counter_attack", "direct_attack", "build_up", "set_piece", "unclassified"]
START_CAUSES = ["regain", "restart", "gap", "half_start", "unknown"]
END_CAUSES = ["shot", "turnover", "gap", "half_end", "stream_end"]


@dataclass(frozen=True)
class Thresholds:
    """Published limits of the chain types, in centimetres."""

    high_turnover_distance: float = 4000.0
    counter_progression: float = 18 * 91.44
    counter_directness: float = 0.75
    counter_start_fraction: float = 2 / 3
    direct_directness: float = 0.5
    direct_band: float = 1000.0
    build_up_passes: int = 10


def _paths(chained: DataFrame, pitch: G.Pitch) -> DataFrame:
    """Per chain the polyline over starts and ends of its own club's events: first and last point, length; and whether it touched the box."""
    own = chained.where("club_id = chain_club")
    places = F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("px"), F.col("y").alias("py")), F.struct(F.lit(1).alias("side"), F.col("end_x").alias("px"), F.col("end_y").alias("py")))
    points = own.select("match_id", "chain_id", *ORDER, F.inline(places)).where("px is not null")
    along = Window.partitionBy("match_id", "chain_id").orderBy(*ORDER, "side")
    step = G.distance(F.lag("px").over(along), F.lag("py").over(along), F.col("px"), F.col("py"))
    place, at = F.struct("px", "py"), F.struct(*ORDER, "side")
    box = F.bool_or((F.col("side") == 0) & G.in_box(F.col("px"), F.col("py"), pitch))
    return points.withColumn("step", step).groupBy("match_id", "chain_id").agg(
        F.min_by(place, at).alias("first_point"), F.max_by(place, at).alias("last_point"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"), box.alias("has_box_touch")
    )


def causes(chains: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """Adds start_cause and end_cause from the chains before and after."""
    order = Window.partitionBy("match_id").orderBy("chain_id")
    rows = chains.withColumns({"_before": F.lag(F.struct("club_id", "last")).over(order), "_after": F.lead(F.struct("club_id", "first")).over(order)})
    first, last = F.col("first"), F.col("last")
    gap_before, gap_after = first["t"] - F.col("_before.last.t"), F.col("_after.first.t") - last["t"]
    start = (
        F.when((first["type"] == "throw_in") & (first["club_id"] == F.col("club_id")), "restart")
        .when(F.col("_before").isNull() | (F.col("_before.last.half") != first["half"]), "half_start")
        .when(gap_before > max_gap, "gap")
        .when(F.col("_before.club_id") != F.col("club_id"), "regain")
        .otherwise("unknown")
    )
    end = (
        F.when(F.col("last_own.type") == "shot", "shot")
        .when(F.col("_after").isNull(), "stream_end")
        .when(F.col("_after.first.half") != last["half"], "half_end")
        .when(gap_after > max_gap, "gap")
        .otherwise("turnover")
    )
    return rows.withColumns({"start_cause": start, "end_cause": end}).drop("_before", "_after")


def measured(chained: DataFrame, pitch: G.Pitch = G.FIFA, max_gap: float = MAX_GAP) -> DataFrame:
    """Every chain with its causes, path, progression, directness and whether it ends in a shot."""
    rows = causes(chain_table(chained), max_gap).join(_paths(chained, pitch), ["match_id", "chain_id"], "left")
    x, y, ex, ey = (F.col(c) for c in ("first_point.px", "first_point.py", "last_point.px", "last_point.py"))
    rows = rows.withColumns({"start_distance": G.goal_distance(x, y, pitch), "progression": F.coalesce(G.progression(x, y, ex, ey, pitch), F.lit(0.0)), "ends_in_shot": F.coalesce(F.col("last_own.type") == "shot", F.lit(False))})
    return rows.withColumn("directness", F.col("progression") / F.when(F.col("path_length") > 0, F.col("path_length")))


def label(t: Thresholds = Thresholds(), pitch: G.Pitch = G.FIFA, metric: str = "radial") -> Column:  # noqa: B008
    """The first of the types that holds; high turnovers by distance to the goal ('radial') or to its line ('x_line')."""
    if metric not in ("radial", "x_line"):
        raise ValueError(f"unknown metric {metric!r}")
    x = F.col("first_point.px")
    near = F.col("start_distance") <= t.high_turnover_distance if metric == "radial" else x >= pitch.length - t.high_turnover_distance
    regain, open_play = F.col("start_cause") == "regain", F.col("start_cause") != "restart"
    reaches = F.col("ends_in_shot") | F.col("has_box_touch")
    counter = regain & (x < t.counter_start_fraction * pitch.length) & (F.col("progression") >= t.counter_progression) & (F.col("directness") >= t.counter_directness)
    direct = open_play & (x >= pitch.length / 2 - t.direct_band) & (x < pitch.length / 2) & (F.col("directness") >= t.direct_directness) & reaches
    build = open_play & (F.col("n_own_passes") >= t.build_up_passes) & reaches
    return F.when(x.isNull(), "unclassified").when(regain & near, "high_turnover").when(counter, "counter_attack").when(direct, "direct_attack").when(build, "build_up").otherwise("unclassified")


def classified(chained: DataFrame, pitch: G.Pitch = G.FIFA, max_gap: float = MAX_GAP, thresholds: Thresholds = Thresholds(), metric: str = "radial") -> DataFrame:  # noqa: B008
    return measured(chained, pitch, max_gap).withColumn("chain_type", label(thresholds, pitch, metric))


def _zero_filled(rows: DataFrame, column: str, names: list[str], name: str) -> DataFrame:
    spine = rows.sparkSession.createDataFrame([(x,) for x in names], f"{name} string")
    found = rows.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("_n"))
    return spine.join(found, name, "left").select(name, F.coalesce("_n", F.lit(0)).alias("n_chains"))


def type_counts(chains: DataFrame) -> DataFrame:
    """How many chains of each type, also of those without any."""
    return _zero_filled(chains, "chain_type", TYPES, "chain_type")


def start_cause_counts(chains: DataFrame) -> DataFrame:
    return _zero_filled(chains, "start_cause", START_CAUSES, "start_cause")


def end_cause_counts(chains: DataFrame) -> DataFrame:
    return _zero_filled(chains, "end_cause", END_CAUSES, "end_cause")


def conversion(chains: DataFrame) -> DataFrame:
    """Share of each type's chains that end in a shot; null for fewer than ten."""
    spine = chains.sparkSession.createDataFrame([(x,) for x in TYPES], "chain_type string")
    found = chains.groupBy("chain_type").agg(F.count("*").alias("_n"), F.count(F.when(F.col("ends_in_shot"), 1)).alias("_shots"))
    out = spine.join(found, "chain_type", "left").select("chain_type", F.coalesce("_shots", F.lit(0)).alias("shot_ending"), F.coalesce("_n", F.lit(0)).alias("n_chains"))
    return out.withColumn("conversion", F.round(share(F.col("shot_ending"), F.col("n_chains"), LEAST_DENOMINATOR), 4))


def threshold_sweep(chained: DataFrame, variants: dict[str, Thresholds], pitch: G.Pitch = G.FIFA, max_gap: float = MAX_GAP) -> DataFrame:
    """Chains of each type under several limits, labelled in one pass."""
    rows = measured(chained, pitch, max_gap)
    each = F.array(*(F.struct(F.lit(name).alias("variant"), label(t, pitch).alias("chain_type")) for name, t in variants.items()))
    return rows.select(F.inline(each)).groupBy("variant", "chain_type").agg(F.count("*").alias("n_chains"))


def attack_report(chains: DataFrame, chain_type: str) -> DataFrame:
    """Per match: chains of one type, how many end in a shot, and the rate where there are enough."""
    rows = chains.where(F.col("chain_type") == chain_type)
    out = rows.groupBy("match_id").agg(F.count("*").alias("n_chains"), F.count(F.when(F.col("ends_in_shot"), 1)).alias("shot_ending"))
    return out.withColumn("shot_ending_rate", F.round(share(F.col("shot_ending"), F.col("n_chains"), LEAST_DENOMINATOR), 4))


def turnover_sites(chains: DataFrame, pitch: G.Pitch = G.FIFA) -> DataFrame:
    """Where each regained ball was lost, as the losing club saw it."""
    x, y = G.turned(F.col("first_own.x"), F.col("first_own.y"), pitch)
    return chains.where("start_cause = 'regain' and first_own is not null").select("match_id", "chain_id", "club_id", x.alias("lost_x"), y.alias("lost_y"))

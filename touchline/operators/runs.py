"""Runs of frames: possession segments, fragments, gaps, buckets, and peak picking. All rules are per clip."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G


def islands(rows: DataFrame, keys: list[str], step: int = 1, same: list[str] | None = None, name: str = "run") -> DataFrame:
    """Numbers runs of rows per key: a run ends where frames are more than `step` apart or a column in `same` changes."""
    order = Window.partitionBy(*keys).orderBy("frame")
    breaks = F.lag("frame").over(order).isNull() | (F.col("frame") - F.lag("frame").over(order) > step)
    for c in same or []:
        breaks |= ~F.lag(c).over(order).eqNullSafe(F.col(c))
    return rows.withColumn("_break", breaks).withColumn(name, F.sum(F.col("_break").cast("int")).over(order)).drop("_break")


def possession_segments(timeline: DataFrame, min_frames: int = 3) -> DataFrame:
    """Runs of one possessor on consecutive frames, without those under min_frames; neighbours of one possessor are then one.

    Frames without a possessor end a run. Columns: clip, segment, possessor, team, start, end, n_frames, confidence (the mean).
    """
    held = timeline.where("possessor is not null")
    raw = islands(held, ["clip"], 1, ["possessor"]).groupBy("clip", "run").agg(
        F.first("possessor").alias("possessor"), F.min_by("team", "frame").alias("team"), F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("n"), F.sum("confidence").alias("total")
    )
    raw = raw.where(F.col("n") >= min_frames)
    order = Window.partitionBy("clip").orderBy("run")
    raw = raw.withColumn("segment", F.sum(F.coalesce((F.lag("possessor").over(order) != F.col("possessor")).cast("int"), F.lit(1))).over(order))
    return raw.groupBy("clip", "segment").agg(
        F.first("possessor").alias("possessor"), F.min_by("team", "start").alias("team"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_frames"), (F.sum("total") / F.sum("n")).alias("confidence")
    )


def transition_events(timeline: DataFrame, min_frames: int = 3, first_touch: int = 7, low_confidence: float = 0.45) -> DataFrame:
    """A pass at the end of each segment but the last, a reception at the start unless the pass came at first touch."""
    order = Window.partitionBy("clip").orderBy("segment")
    rows = possession_segments(timeline, min_frames).withColumn("receiver", F.lead("possessor").over(order))
    passes = F.col("receiver").isNotNull()
    event = lambda kind, at, receiver: F.struct(F.lit(kind).alias("type"), F.col(at).alias("frame"), receiver.alias("receiver"))
    nobody = F.lit(None).cast("long")
    events = F.array_compact(F.array(F.when(passes, event("pass", "end", F.col("receiver"))), F.when(~(passes & (F.col("n_frames") < first_touch)), event("reception", "start", nobody))))
    return rows.select("clip", F.col("possessor").alias("player_id"), "team", F.round("confidence", 4).alias("confidence"), (F.col("confidence") < low_confidence).alias("contested"), F.inline(events))


def smoothed(timeline: DataFrame, radius: int = 2) -> DataFrame:
    """Each frame's possessor by majority of the frames around it; its own stays if it is among the winners, else the first met wins."""
    around = Window.partitionBy("clip").orderBy("frame").rowsBetween(-radius, radius)
    rows = timeline.withColumn("near", F.collect_list(F.coalesce("possessor", F.lit(-1))).over(around))
    votes = F.transform(F.array_distinct("near"), lambda x: F.struct(F.size(F.filter("near", lambda y: y == x)).alias("n"), x.alias("who")))
    rows = rows.withColumn("votes", votes).withColumn("most", F.array_max(F.transform("votes", lambda v: v["n"])))
    own = F.coalesce("possessor", F.lit(-1))
    stays = F.exists("votes", lambda v: (v["n"] == F.col("most")) & (v["who"] == own))
    first = F.filter("votes", lambda v: v["n"] == F.col("most"))[0]["who"]
    return rows.select("clip", "frame", F.nullif(F.when(stays, own).otherwise(first), F.lit(-1)).alias("possessor"))


def coverage_profile(timeline: DataFrame, low: float = 0.45) -> DataFrame:
    """Per clip: frames, frames with a possessor, those of low confidence, segments and their mean length."""
    base = timeline.groupBy("clip").agg(F.count("*").alias("n_frames"), F.count("possessor").alias("n_held"), F.count(F.when(F.col("possessor").isNotNull() & (F.col("confidence") < low), 1)).alias("n_low_confidence"))
    raw = islands(timeline.where("possessor is not null"), ["clip"], 1, ["possessor"]).groupBy("clip", "run").agg(F.count("*").alias("n"))
    segments = raw.groupBy("clip").agg(F.count("*").alias("n_segments"), F.round(F.avg("n"), 4).alias("mean_segment"))
    return base.join(segments, "clip", "left").withColumn("coverage", F.round(F.col("n_held") / F.col("n_frames"), 4))


def pooled_profile(profiles: DataFrame) -> DataFrame:
    """Counts of all clips first, fractions last."""
    return profiles.agg(F.sum("n_frames").alias("n_frames"), F.sum("n_held").alias("n_held"), F.sum("n_low_confidence").alias("n_low_confidence")).withColumn("coverage", F.round(F.col("n_held") / F.col("n_frames"), 4))


def fragments(frames: DataFrame, track: str, gap: int = 2, min_frames: int = 1) -> DataFrame:
    """Tracks cut where frames are more than `gap` apart, numbered from 1 per clip by track and time."""
    runs = islands(frames, ["clip", track], gap).groupBy("clip", track, "run").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("n_frames"))
    runs = runs.where(F.col("n_frames") >= min_frames)
    return runs.withColumn("fragment_id", F.row_number().over(Window.partitionBy("clip").orderBy(track, "run"))).drop("run")


def observable_spans(frames: DataFrame, track: str, max_gap: int = 2) -> DataFrame:
    """First and last frame of each stretch in which a track is seen, holes of up to max_gap frames closed."""
    return fragments(frames, track, max_gap + 1).select("clip", track, "start", "end")


def interpolated_ball(ball: DataFrame, max_gap: int = 30) -> DataFrame:
    """Observed frames, and between observations of at most max_gap frames a straight line with half the lower confidence."""
    order = Window.partitionBy("clip").orderBy("frame")
    rows = ball.withColumn("after", F.lead(F.struct("frame", "x", "y", "confidence")).over(order))
    gap = F.col("after.frame") - F.col("frame")
    steps = F.when((gap > 1) & (gap <= max_gap), F.sequence(F.lit(0).cast("long"), gap - 1)).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.withColumn("gap", gap).withColumn("k", F.explode(steps))
    part = F.col("k") / F.col("gap")
    line = lambda c: F.when(F.col("k") == 0, F.col(c)).otherwise(F.col(c) + part * (F.col(f"after.{c}") - F.col(c)))
    confidence = F.when(F.col("k") == 0, F.col("confidence")).otherwise(F.least("confidence", "after.confidence") * 0.5)
    return rows.select("clip", (F.col("frame") + F.col("k")).alias("frame"), line("x").alias("x"), line("y").alias("y"), confidence.alias("confidence"), (F.col("k") > 0).alias("interpolated"))


def timeline_buckets(dets: DataFrame, fps: float = 25.0, bucket_s: float = 1.0) -> DataFrame:
    """Per clip and second: mean of the frames' mean confidence, active, born and ended tracklets, stability and flags; empty seconds too."""
    bucket = lambda c: F.floor(F.col(c) / fps / bucket_s)
    frames = dets.groupBy("clip", "frame").agg(F.avg("confidence").alias("c"))
    seen = frames.groupBy("clip", bucket("frame").alias("bucket")).agg(F.avg("c").alias("confidence"))
    tracks = dets.groupBy("clip", "tracklet_id").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    active = tracks.select("clip", F.explode(F.sequence(bucket("start"), bucket("end"))).alias("bucket"), bucket("start").alias("b"), bucket("end").alias("d"))
    active = active.groupBy("clip", "bucket").agg(F.count("*").alias("n_active"), F.count(F.when(F.col("b") == F.col("bucket"), 1)).alias("births"), F.count(F.when(F.col("d") == F.col("bucket"), 1)).alias("deaths"))
    spine = frames.groupBy("clip").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max(bucket("frame")))).alias("bucket"))
    out = spine.join(seen, ["clip", "bucket"], "left").join(active, ["clip", "bucket"], "left")
    n = F.coalesce("n_active", F.lit(0))
    stability = F.when(n > 0, F.greatest(F.lit(0.0), 1 - (F.col("births") + F.col("deaths")) / n)).otherwise(0.0)
    out = out.select("clip", "bucket", F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("detection_confidence"), n.alias("n_active"), F.round(stability, 4).alias("tracking_stability"), F.col("confidence").isNotNull().alias("seen"))
    flags = F.concat_ws(",", F.when(F.col("seen") & (F.col("detection_confidence") < 0.4), "weak_detection"), F.when((F.col("n_active") > 0) & (F.col("tracking_stability") < 0.5), "track_churn"))
    return out.withColumn("flags", flags).drop("seen")


def possessor_candidates(ball: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes of the ball's frame by distance to the ball, then tracklet."""
    b = boxes.select("clip", "frame", "tracklet_id", F.col("x").alias("bx"), F.col("y").alias("by"), "w", "h", F.col("confidence").alias("box_confidence"))
    rows = ball.join(b, ["clip", "frame"]).withColumn("distance", G.box_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"), F.col("bx") + F.col("w"), F.col("by") + F.col("h")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("clip", "frame").orderBy("distance", "tracklet_id")))


def nearest_possessor(ball: DataFrame, boxes: DataFrame, radius: float = 60.0, min_margin: float = 0.0, interpolated_weight: float = 0.75) -> DataFrame:
    """Per ball frame the nearest tracklet within the radius and clear of the second; else nobody. Needs ball.interpolated."""
    ranked = possessor_candidates(ball, boxes)
    two = ranked.where("rank <= 2").groupBy("clip", "frame").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("tracklet_id", "distance", "box_confidence"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second")
    )
    rows = ball.join(two, ["clip", "frame"], "left")
    margin = F.coalesce("second", F.col("a.distance") + radius) - F.col("a.distance")
    held = (F.col("a.distance") <= radius) & (margin >= min_margin)
    weight = F.when(F.col("interpolated"), interpolated_weight).otherwise(1.0)
    confidence = F.when(held, F.least(F.lit(1.0), F.col("confidence") * F.col("a.box_confidence") * weight)).otherwise(0.0)
    return rows.select("clip", "frame", F.when(held, F.col("a.tracklet_id")).alias("possessor"), F.round(confidence, 4).alias("confidence"), F.round(F.coalesce(margin, F.lit(0.0)), 3).alias("margin"))


def suppress(rows: DataFrame, keys: list[str], window: int, score: str = "score") -> DataFrame:
    """Greedy one-dimensional non-maximum suppression per key: by falling score (equal scores: the earlier frame), frames within the window of a kept one go."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([score, "frame"], ascending=[False, True], kind="stable")
        frames, kept = group["frame"].to_numpy(), []
        gone = np.zeros(len(frames), dtype=bool)
        for i, at in enumerate(frames):
            if not gone[i]:
                kept.append(i)
                gone |= np.abs(frames - at) <= window
        return group.iloc[kept]

    return rows.groupBy(*keys).applyInPandas(keep, rows.schema)


def camera_shift(boxes: DataFrame) -> DataFrame:
    """Per frame the upper median of all tracklets' moves since the frame before."""
    centre = boxes.select("clip", "frame", "tracklet_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    order = Window.partitionBy("clip", "tracklet_id").orderBy("frame")
    moves = centre.withColumn("before", F.lag(F.struct("frame", "cx", "cy")).over(order)).where("before.frame = frame - 1")
    moves = moves.select("clip", "frame", (F.col("cx") - F.col("before.cx")).alias("dx"), (F.col("cy") - F.col("before.cy")).alias("dy"))
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int") + 1)
    return moves.groupBy("clip", "frame").agg(upper("dx").alias("shift_x"), upper("dy").alias("shift_y"))


def ball_touches(ball: DataFrame, boxes: DataFrame | None = None, radius: int = 2, min_speed: float = 1.5, threshold: float = 0.35, separation: int = 6, weight: float = 0.5) -> DataFrame:
    """Frames at which the ball turns or changes speed. Needs ball.interpolated; boxes give the camera's own motion."""
    rows = islands(ball, ["clip"])
    if boxes is not None:
        rows = rows.join(camera_shift(boxes), ["clip", "frame"], "left").fillna(0.0, ["shift_x", "shift_y"])
    else:
        rows = rows.withColumns({"shift_x": F.lit(0.0), "shift_y": F.lit(0.0)})
    run = Window.partitionBy("clip", "run").orderBy("frame")
    # A step from one observation to the next stands at the earlier one, as do the scores.
    dx = F.lead("x").over(run) - F.col("x") - F.lead("shift_x").over(run)
    dy = F.lead("y").over(run) - F.col("y") - F.lead("shift_y").over(run)
    steps = rows.withColumns({"dx": dx, "dy": dy}).where("dx is not null")
    around = run.rowsBetween(-radius, radius)
    steps = steps.withColumns({"sx": F.avg("dx").over(around), "sy": F.avg("dy").over(around)})
    lag = radius + 1
    for name, function in (("in", F.lag), ("out", F.lead)):
        steps = steps.withColumns({f"{name}_x": function("sx", lag).over(run), f"{name}_y": function("sy", lag).over(run)})
    steps = steps.where("in_x is not null and out_x is not null")
    length = lambda n: F.sqrt(F.col(f"{n}_x") * F.col(f"{n}_x") + F.col(f"{n}_y") * F.col(f"{n}_y"))
    n_in, n_out = length("in"), length("out")
    cosine = (F.col("in_x") * F.col("out_x") + F.col("in_y") * F.col("out_y")) / (n_in * n_out)
    turn = F.when((n_in < 1e-9) | (n_out < 1e-9), 0.0).otherwise((1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / 2)
    change = F.abs(n_out - n_in) / (n_in + n_out + 1e-9)
    score = F.greatest(turn, change) * F.when(F.col("interpolated"), weight).otherwise(1.0)
    scored = steps.where(~((n_in < min_speed) & (n_out < min_speed))).select("clip", "frame", F.round(score, 4).alias("score"), F.round(turn, 4).alias("turn"), F.round(change, 4).alias("speed_change"))
    return suppress(scored.where(F.col("score") >= threshold), ["clip"], separation - 1)


def resolved_ball(candidates: DataFrame, memory: int = 10) -> DataFrame:
    """One ball a frame: the most confident while there is no history, else the nearest to the mean of the last picks."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        out, recent = [], []
        for _, rows in group.sort_values(["frame", "det_id"]).groupby("frame", sort=True):
            if not recent or len(rows) == 1:
                best = rows["confidence"].idxmax()
            else:
                cx, cy = np.mean(recent[-memory:], axis=0)
                best = ((rows["x"] - cx) ** 2 + (rows["y"] - cy) ** 2).idxmin()
            recent.append((rows.loc[best, "x"], rows.loc[best, "y"]))
            out.append(best)
        return group.loc[out]

    return candidates.groupBy("clip").applyInPandas(pick, candidates.schema)


def viterbi_possession(
    ball: DataFrame, boxes: DataFrame, teams: DataFrame, radius: float = 60.0, most: int = 4, loose: float = 1.2, switch: float = 2.0, touch_bonus: float = 1.5, no_touch: float = 0.75, tolerance: int = 4,
    min_travel: float = 8.0, window: int = 3, no_travel: float = 2.0, flip: float = 1.0, distance_weight: float = 1.0, confidence_weight: float = 0.3, interpolated_weight: float = 0.75,
) -> DataFrame:
    """The cheapest possessor path per clip: near boxes are cheap, changes cost less at touches and more when the ball did not travel."""
    ranked = possessor_candidates(ball, boxes).where((F.col("distance") <= radius) & (F.col("rank") <= most))
    ranked = ranked.join(teams, ["clip", "tracklet_id"], "left")
    sure = F.least(F.lit(1.0), F.col("confidence") * F.col("box_confidence") * F.when(F.col("interpolated"), interpolated_weight).otherwise(1.0))
    cost = distance_weight * F.col("distance") / radius - confidence_weight * F.log(F.greatest(F.lit(1e-9), sure))
    states = ranked.groupBy("clip", "frame").agg(F.sort_array(F.collect_list(F.struct("rank", "tracklet_id", "team", cost.alias("cost")))).alias("states"))
    travelled = ball.select("clip", "frame", "x", "y")
    early = travelled.select("clip", (F.col("frame") + window).alias("frame"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    late = travelled.select("clip", (F.col("frame") - window).alias("frame"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    rows = travelled.join(early, ["clip", "frame"], "left").join(late, ["clip", "frame"], "left").join(states, ["clip", "frame"], "left")
    rows = rows.join(ball_touches(ball, boxes).select("clip", "frame", F.lit(True).alias("touch")), ["clip", "frame"], "left")
    rows = rows.select("clip", "frame", "states", F.coalesce("touch", F.lit(False)).alias("touch"), G.distance(F.col("ex"), F.col("ey"), F.col("lx"), F.col("ly")).alias("travel"))

    def decode(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame", ignore_index=True)
        frames, touches = group["frame"].to_numpy(), group.loc[group["touch"], "frame"].to_numpy()
        near = np.array([bool(len(touches)) and np.abs(touches - f).min() <= tolerance for f in frames])
        travel = group["travel"].fillna(math.inf).to_numpy()
        columns = [[(None, None, loose), *((int(s["tracklet_id"]), s["team"], float(s["cost"])) for s in (states if states is not None else []))] for states in group["states"]]
        best, back = np.array([c[2] for c in columns[0]]), []
        for k in range(1, len(columns)):
            before, now = columns[k - 1], columns[k]
            step = np.zeros((len(before), len(now)))
            for i, (a, team_a, _) in enumerate(before):
                for j, (b, team_b, _) in enumerate(now):
                    if a != b:
                        c = switch + (-touch_bonus if near[k] else no_touch)
                        if a is not None and b is not None:
                            c += no_travel * (travel[k] < min_travel) + flip * (team_a is not None and team_b is not None and team_a != team_b)
                        step[i, j] = max(0.0, c)
            reach = best[:, None] + step
            back.append(reach.argmin(axis=0))
            best = reach.min(axis=0) + np.array([c[2] for c in now])
        at = int(best.argmin())
        path = [at]
        for pointers in reversed(back):
            at = int(pointers[at])
            path.append(at)
        who = [columns[k][i][0] for k, i in enumerate(reversed(path))]
        return pd.DataFrame({"clip": group["clip"], "frame": frames, "possessor": pd.array(who, dtype="Int64")})

    return rows.groupBy("clip").applyInPandas(decode, "clip long, frame long, possessor long")


def persistent_switches(matches: DataFrame, fps: float = 25.0, thresholds: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Per threshold, changes of a subject's matched id between runs that last at least so many seconds. matches: clip, gt_id, frame, hyp_id."""
    order = Window.partitionBy("clip", "gt_id").orderBy("frame")
    rows = matches.withColumn("run", F.sum(F.coalesce((F.lag("hyp_id").over(order) != F.col("hyp_id")).cast("int"), F.lit(1))).over(order))
    runs = rows.groupBy("clip", "gt_id", "run").agg(F.first("hyp_id").alias("hyp_id"), F.count("*").alias("n"), F.min("frame").alias("start"))
    each = runs.withColumn("threshold_s", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col("n") / fps >= F.col("threshold_s"))
    before = F.lag("hyp_id").over(Window.partitionBy("clip", "gt_id", "threshold_s").orderBy("run"))
    return each.withColumn("switch", (before != F.col("hyp_id")).cast("int")).groupBy("threshold_s").agg(F.coalesce(F.sum("switch"), F.lit(0)).alias("n_switches"))


def rolling(column: str, radius: int, keys: list[str]) -> Column:
    """Centred moving average over rows, cut at the edges."""
    return F.avg(column).over(Window.partitionBy(*keys).orderBy("frame").rowsBetween(-radius, radius))


def possession_sheet(events: DataFrame, segments: DataFrame, fps: float = 25.0) -> DataFrame:
    """Passes, missed passes, touches, restarts and seconds with the ball per clip and player. events: clip, kind, player_id; segments: as from possession_segments()."""
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in (("pass", "passes"), ("missed_pass", "missed_passes"), ("touch", "touches"), ("restart", "restarts"))]
    counts = events.where("player_id is not null").groupBy("clip", "player_id").agg(*kinds)
    held = segments.groupBy("clip", F.col("possessor").alias("player_id")).agg(F.round(F.sum((F.col("end") - F.col("start")) / fps), 2).alias("possession_seconds"))
    out = counts.join(held, ["clip", "player_id"], "full_outer")
    return out.fillna(0, ["passes", "missed_passes", "touches", "restarts"]).fillna(0.0, ["possession_seconds"])

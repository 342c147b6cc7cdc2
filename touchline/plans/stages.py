"""The clip pipeline as registered stages: each takes and gives DataFrames, a run names one implementation a slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import evaluation, pairs, runs, tracker
from touchline.operators.governance import build, stage

DEFAULT = {"detect": "frozen", "track": "iou", "team": "colour", "associate": "mutual-best", "possession": "viterbi", "events": "transitions"}


@stage("detect", "frozen")
def frozen(detections: DataFrame) -> DataFrame:
    """Detections as they were stored."""
    return detections


@stage("detect", "confident")
def confident(detections: DataFrame, least: float = 0.3) -> DataFrame:
    return detections.where(F.col("confidence") >= least)


@stage("track", "iou")
def iou(detections: DataFrame) -> DataFrame:
    tracks = tracker.iou_tracker(detections)
    return detections.drop("tracklet_id").join(tracks.withColumnRenamed("track_id", "tracklet_id"), ["clip", "frame", "det_id"])


@stage("track", "frozen")
def frozen_tracks(detections: DataFrame) -> DataFrame:
    """The tracklets that the detections already carry."""
    return detections


@stage("team", "colour")
def colour(features: DataFrame) -> DataFrame:
    return tracker.team_colours(features)


@stage("associate", "per-tracklet")
def per_tracklet(tracklets: DataFrame) -> DataFrame:
    """Every tracklet its own thread."""
    return tracklets.select("clip", "tracklet_id", F.col("tracklet_id").alias("thread_id"))


@stage("associate", "mutual-best")
def mutual(tracklets: DataFrame) -> DataFrame:
    return pairs.merge_tracklets(tracklets, pairs.mutual_best(pairs.scored_pairs(tracklets)))


@stage("possession", "none")
def nobody(ball: DataFrame, boxes: DataFrame, teams: DataFrame) -> DataFrame:
    return ball.select("clip", "frame", F.lit(None).cast("long").alias("possessor"))


@stage("possession", "nearest")
def nearest(ball: DataFrame, boxes: DataFrame, teams: DataFrame) -> DataFrame:
    return runs.nearest_possessor(ball, boxes).select("clip", "frame", "possessor")


@stage("possession", "viterbi")
def viterbi(ball: DataFrame, boxes: DataFrame, teams: DataFrame) -> DataFrame:
    return runs.viterbi_possession(ball, boxes, teams)


@stage("events", "transitions")
def transitions(timeline: DataFrame) -> DataFrame:
    return runs.transition_events(timeline)


@stage("evaluate", "detections")
def evaluate(detections: DataFrame, truth: DataFrame) -> DataFrame:
    return evaluation.detection_report(evaluation.match_frames(detections, truth), truth)


def run(detections: DataFrame, ball: DataFrame, teams: DataFrame, stages: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """From detections (clip, frame, det_id, x, y, w, h, confidence) and the ball to possession events; what each stage gave, by slot. teams: clip, tracklet_id, team."""
    chosen = {**DEFAULT, **(stages or {})}
    out = {"detect": build("detect", chosen["detect"])(detections)}
    out["track"] = build("track", chosen["track"])(out["detect"])
    out["possession"] = build("possession", chosen["possession"])(runs.interpolated_ball(ball), out["track"], teams)
    timeline = out["possession"].join(teams.withColumnRenamed("tracklet_id", "possessor"), ["clip", "possessor"], "left").withColumn("confidence", F.lit(1.0))
    out["events"] = build("events", chosen["events"])(timeline)
    return out

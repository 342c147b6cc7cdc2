"""Tracking-shaped rows from the driver's events: clips of 400 events, in integer arithmetic.

True and detected boxes (x, y, width, height), tracklet frames, a possessor timeline, a ball track, labelled and spotted actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.matches import table

CLIP = 400


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("long")
    return table(spark, sf_dir, "events").select(e.alias("e"), F.floor(e / CLIP).cast("long").alias("clip"), (e % CLIP).alias("at"))


def true_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, gt_id, x, y, w, h: four subjects that walk side by side, now and then out of sight."""
    rows = _events(spark, sf_dir).where("e % 23 <> 0").select("clip", F.floor(F.col("at") / 4).cast("long").alias("frame"), (F.col("e") % 4).alias("gt_id"))
    x = (F.col("gt_id") * 40 + F.col("frame") * 2).cast("double")
    return rows.select("clip", "frame", "gt_id", x.alias("x"), (100 + F.col("gt_id") * 3).cast("double").alias("y"), F.lit(60.0).alias("w"), (60 + F.col("gt_id") * 30).cast("double").alias("h"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, det_id, tracklet_id, x, y, w, h, confidence: shaken boxes, some missing, identities swapped for a while."""
    rows = _events(spark, sf_dir).where("e % 11 <> 0")
    e = F.col("e")
    rows = rows.withColumns({"frame": F.floor(F.col("at") / 4).cast("long"), "who": e % 4})
    swapped = F.when(F.floor(F.col("frame") / 10) % 5 == 4, (F.col("who") + 1) % 4).otherwise(F.col("who"))
    return rows.select(
        "clip", "frame", e.alias("det_id"), (swapped * 10 + F.floor(F.col("frame") / 25)).cast("long").alias("tracklet_id"),
        (F.col("who") * 40 + F.col("frame") * 2 + e * 7 % 13 - 6).cast("double").alias("x"), (100 + F.col("who") * 3 + e * 11 % 9 - 4).cast("double").alias("y"),
        F.lit(60.0).alias("w"), (60 + F.col("who") * 30 + e * 5 % 7 - 3).cast("double").alias("h"), (e * 37 % 1000 / 1000).alias("confidence"),
    )


def possessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, possessor (null: nobody), team, confidence; some frames are missing."""
    rows = _events(spark, sf_dir).where("e % 37 <> 0")
    who = F.when(F.col("e") % 17 != 0, F.floor(F.col("e") / 6).cast("long") * 7 % 5)
    return rows.select("clip", F.col("at").alias("frame"), who.alias("possessor"), (who % 2).alias("team"), (F.col("e") * 13 % 100 / 100).alias("confidence"))


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, x, y, confidence of the observed ball; runs of frames without one."""
    e = F.col("e")
    rows = _events(spark, sf_dir).where("e % 19 > 2 and e % 100 < 80")
    x = F.when(F.floor(F.col("at") / 20) % 2 == 0, F.col("at") * 6 % 240).otherwise(240 - F.col("at") * 6 % 240)
    return rows.select("clip", F.col("at").alias("frame"), (x + e * 7 % 5).cast("double").alias("x"), (140 + e * 3 % 17 + F.col("at") % 40).cast("double").alias("y"), (e * 29 % 100 / 100).alias("confidence"))


def labelled_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, event_id, class_id, slot, frame, has_box: every event as a labelled action."""
    rows = _events(spark, sf_dir)
    e = F.col("e")
    return rows.select("clip", e.alias("event_id"), (F.floor(e / 3) % 4 + 1).cast("int").alias("class_id"), (F.floor(e / 12) % 3).cast("int").alias("slot"), (F.col("at") * 3).alias("frame"), (e % 5 != 0).alias("has_box"))


def spotted_actions(spark: SparkSession, sf_dir: str, model: int = 0) -> DataFrame:
    """clip, event_id, class_id, slot, frame, score of one model's actions: shaken labelled ones, some of another class; a fifth is missed."""
    rows = _events(spark, sf_dir).where((F.col("e") + model) % 5 != 0)
    e = F.col("e")
    class_id = F.when((e + model) % 13 == 0, F.floor(e / 3) % 4 + 2).otherwise(F.floor(e / 3) % 4 + 1)
    frame = F.greatest(F.lit(0), F.col("at") * 3 + (e * (7 + model)) % 33 - 16)
    return rows.select("clip", e.alias("event_id"), class_id.cast("int").alias("class_id"), (F.floor(e / 12) % 3).cast("int").alias("slot"), frame.alias("frame"), ((e * 41 + model * 17) % 1000 / 1000).alias("score"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, tracklet_id, start, end, team, label, embedding: the vectors as tracklets of clips of 40."""
    v = F.col("vec_id").cast("long")
    start = (v % 40) * 25
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 40).cast("long").alias("clip"), (v % 40).alias("tracklet_id"), start.alias("start"), (start + 10 + v * 7 % 30).alias("end"), (v * 3 % 2).alias("team"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, team, frame, player_id, x, y (unit): two teams of ten, shaken about their places."""
    e, who = F.col("e"), F.col("e") % 20
    rows = _events(spark, sf_dir).select("clip", F.floor(who / 10).cast("long").alias("team"), F.floor(F.col("at") / 20).cast("long").alias("frame"), who.alias("player_id"), "e")
    x = (F.floor(F.col("player_id") % 10 / 3) * 20 + 10 + e * 7 % 11) / 100
    y = (F.col("player_id") * 37 % 90 + e * 13 % 7) / 100
    return rows.select("clip", "team", "frame", "player_id", x.alias("x"), y.alias("y"))


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, tracklet_id, frame, feature: the vectors as frames of tracklets of ten."""
    v = F.col("vec_id").cast("long")
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 40).cast("long").alias("clip"), F.floor(v % 40 / 10).cast("long").alias("tracklet_id"), (v % 40).alias("frame"), F.col("embedding").cast("array<double>").alias("feature"))


def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate, sequence, role, metric, value from the line items."""
    rows = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_linenumber") % 2 == 0, "test").otherwise("tuning")
    return rows.select(F.concat("l_returnflag", "l_linestatus").alias("candidate"), (F.col("l_suppkey") % 10).alias("sequence"), role.alias("role"), F.lit("quantity").alias("metric"), F.col("l_quantity").alias("value"))


def half_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a position table as touchline.sources.halves names them: two clips are a game, ten players a frame, every second half of a clip with substitutes; some have no role, a role too high, no shirt, no box or no label."""
    rows = _events(spark, sf_dir)
    e, who, late = F.col("e"), F.col("e") % 10, F.floor(F.col("at") / 200).cast("long")
    number = who % 5 + 1 + late * 10
    half = F.concat(F.lit("game_"), F.floor(F.col("clip") / 2).cast("string"), F.lit("_H"), (F.col("clip") % 2 + 1).cast("string"))
    seen = lambda v: F.when(e % 3 != 0, v.cast("double"))
    return rows.select(
        half.alias("half_key"), e.alias("row"), F.floor(F.col("at") / 10).cast("long").alias("frame"), ((F.floor(who / 5) + 1) * 100 + number).cast("long").alias("player_id"), F.floor(who / 5).cast("int").alias("side"),
        F.when(e % 7 != 0, number).alias("shirt"), F.when(e % 41 != 0, F.when(e % 43 == 0, 14).otherwise(who % 5 * 3 + 1)).cast("int").alias("role"),
        seen(e * 7 % 1800).alias("roi_x"), seen(e * 5 % 1000).alias("roi_y"), seen(F.lit(30)).alias("roi_w"), seen(F.lit(90)).alias("roi_h"), F.when(e % 29 != 0, e % 9).cast("int").alias("class_id"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, gt_id, role, team, jersey of the true boxes' subjects; one has a letter for a number, one is a referee."""
    rows = true_boxes(spark, sf_dir).select("clip", "gt_id").distinct()
    role = F.when(F.col("gt_id") == 3, "referee").when(F.col("gt_id") == 2, "goalkeeper").otherwise("player")
    return rows.select("clip", "gt_id", role.alias("role"), F.when(F.col("gt_id") % 2 == 0, "left").otherwise("right").alias("team"), F.when((F.col("gt_id") == 1) & (F.col("clip") % 2 == 0), "A").otherwise((F.col("gt_id") + 7).cast("string")).alias("jersey"))

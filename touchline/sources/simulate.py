"""A simulated match and its detections: spark.range and hashes, the same again for a seed in any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import pitch as G

#: Places of a team's eleven, as shares of its half's length and of the width.
PLACES = [(0.06, 0.5), (0.3, 0.15), (0.27, 0.38), (0.27, 0.62), (0.3, 0.85), (0.55, 0.2), (0.5, 0.42), (0.5, 0.58), (0.55, 0.8), (0.85, 0.4), (0.85, 0.6)]


def uniform(seed: int, *parts: Column) -> Column:
    """53 hashed bits in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) * F.lit(2.0**-53)


def players(spark: SparkSession, frames: int, seed: int = 0, fps: float = 25.0, pitch: G.Pitch = G.FIFA) -> DataFrame:
    """frame, team, player_id, x, y (cm): each player sways about the own place, both teams drift with the play."""
    places = F.array(*(F.struct(F.lit(x).alias("px"), F.lit(y).alias("py")) for x, y in PLACES))
    rows = spark.range(frames).select(F.col("id").alias("frame"), F.explode(F.array(F.lit(0), F.lit(1))).alias("team"), F.posexplode(places).alias("place", "at"))
    t = F.col("frame") / fps
    drift = 600 * F.sin(t * 2 * math.pi / 45)
    phase = uniform(seed, F.col("team"), F.col("place")) * 2 * math.pi
    x = F.col("at.px") * pitch.length * 0.55 + drift * F.when(F.col("team") == 0, 1).otherwise(-1) + 150 * F.sin(t * 0.9 + phase)
    y = F.col("at.py") * pitch.width + 150 * F.cos(t * 0.7 + phase)
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), v))
    x, y = clamp(x, pitch.length), clamp(y, pitch.width)
    side = F.col("team") == 0
    return rows.select("frame", "team", (F.col("team") * 100 + F.col("place") + 1).alias("player_id"), F.when(side, x).otherwise(pitch.length - x).alias("x"), F.when(side, y).otherwise(pitch.width - y).alias("y"))


def possessor(frames: DataFrame, seed: int = 0, hold: int = 50) -> DataFrame:
    """frame, player_id: somebody has the ball for `hold` frames at a time. frames: frame."""
    spell = F.floor(F.col("frame") / hold)
    team = F.floor(uniform(seed, F.lit("team"), F.floor(spell / 4)) * 2).cast("int")
    return frames.select("frame", (team * 100 + F.floor(uniform(seed, F.lit("who"), spell) * 11) + 1).alias("player_id"))


def detections(positions: DataFrame, seed: int = 0, dropout: float = 0.05, noise: float = 2.0, scale: float = 0.18) -> DataFrame:
    """Boxes as a camera above the touchline would see them: shaken, some missing. positions: frame, player_id, x, y."""
    seen = positions.where(uniform(seed, F.lit("drop"), F.col("frame"), F.col("player_id")) >= dropout)
    shake = lambda name: F.sqrt(-2 * F.log(1 - uniform(seed, F.lit(name), F.col("frame"), F.col("player_id")))) * F.cos(2 * math.pi * uniform(seed, F.lit(name + "'"), F.col("frame"), F.col("player_id"))) * noise
    h = 30 + 50 * F.col("y") / 6800
    confidence = F.greatest(F.lit(0.3), F.least(F.lit(0.99), 0.82 + shake("c") / noise * 0.1))
    return seen.select("frame", F.xxhash64("frame", "player_id").alias("det_id"), "player_id", (F.col("x") * scale - h * 0.225 + shake("x")).alias("x"), (F.col("y") * scale * 0.6 - h + shake("y")).alias("y"), (h * 0.45).alias("w"), h.alias("h"), confidence.alias("confidence"))


def oracle(truth: DataFrame, seed: int = 0, dropout: float = 0.0, jitter: float = 0.0) -> DataFrame:
    """True boxes as detections, with a share missing and shaken by up to `jitter`. truth: clip, frame, gt_id, x, y, w, h."""
    key = [F.col("clip"), F.col("frame"), F.col("gt_id")]
    move = lambda name: (uniform(seed, F.lit(name), *key) * 2 - 1) * jitter
    rows = truth.where(uniform(seed, F.lit("drop"), *key) >= dropout)
    return rows.select("clip", "frame", F.xxhash64(*key).alias("det_id"), F.col("gt_id").alias("tracklet_id"), (F.col("x") + move("x")).alias("x"), (F.col("y") + move("y")).alias("y"), "w", "h", F.lit(1.0).alias("confidence"))

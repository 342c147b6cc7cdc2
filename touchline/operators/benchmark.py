"""Benchmark rows: aggregation, comparison with a baseline, differences of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate(rows: DataFrame, by_role: bool = True) -> DataFrame:
    """Mean, median, least and most of each candidate's metric, over all sequences and by role (role null: all). rows: candidate, role, metric, value."""
    stats = [F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("median"), F.min("value").alias("least"), F.max("value").alias("most")]
    if not by_role:
        return rows.groupBy("candidate", "metric").agg(*stats)
    sets = [[F.col("candidate"), F.col("metric"), F.col("role")], [F.col("candidate"), F.col("metric")]]
    return rows.groupingSets(sets, "candidate", "metric", "role").agg(*stats)


def compare(rows: DataFrame, baseline: str, tolerance: float, higher_is_better: bool = True) -> DataFrame:
    """Each candidate's mean against the baseline's: improved, regressed or within tolerance; refused where the sequences differ. rows: candidate, sequence, metric, value."""
    means = rows.groupBy("candidate", "metric").agg(F.avg("value").alias("mean"), F.sort_array(F.collect_set("sequence")).alias("sequences"))
    base = means.where(F.col("candidate") == baseline).select("metric", F.col("mean").alias("base"), F.col("sequences").alias("base_sequences"))
    delta = F.col("mean") - F.col("base")
    gain = delta if higher_is_better else -delta
    verdict = F.when(F.col("sequences") != F.col("base_sequences"), "sequence_mismatch").when(gain > tolerance, "improved").when(gain < -tolerance, "regressed").otherwise("within_tolerance")
    out = means.where(F.col("candidate") != baseline).join(base, "metric")
    return out.select("candidate", "metric", F.round("mean", 4).alias("mean"), F.round("base", 4).alias("base"), F.round(delta, 4).alias("delta"), verdict.alias("verdict"))


def run_board(runs: DataFrame) -> DataFrame:
    """Completed runs by configuration and video: how many, mean and range of each metric. runs: run_id, config, video, status, metrics (map)."""
    rows = runs.where("status = 'completed' and metrics is not null").select("config", "video", "run_id", F.explode("metrics").alias("metric", "value"))
    out = rows.groupBy("config", "video", "metric").agg(F.countDistinct("run_id").alias("n_runs"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.orderBy("config", "video", "metric")


def metric_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics of two runs over the union of their names. a, b: metric, value."""
    rows = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    return rows.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Settings that differ. a, b: path, value."""
    rows = a.select("path", F.col("value").alias("a")).join(b.select("path", F.col("value").alias("b")), "path", "full_outer")
    return rows.where(~F.col("a").eqNullSafe(F.col("b")))


def camera_scores(images: DataFrame, total_images: int) -> DataFrame:
    """Per threshold the mean of the images' own accuracy (never pooled), completeness and their product. images: threshold, tp, fp, fn."""
    each = F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    out = images.groupBy("threshold").agg(F.avg(each).alias("accuracy"), F.count("*").alias("predicted"))
    complete = F.col("predicted") / total_images
    return out.select("threshold", F.round("accuracy", 4).alias("accuracy"), F.round(complete, 4).alias("completeness"), F.round(F.col("accuracy") * complete, 4).alias("final"))


def balanced_sample(rows: DataFrame, by: str, most: int, key: str, seed: int = 0) -> DataFrame:
    """At most `most` rows of each class, by hashed order: the feature is the limit."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")

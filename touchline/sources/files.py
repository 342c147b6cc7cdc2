"""File formats of tracking work: MOT text, INI, wide position tables, JSON lines, run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class RunFolder:
    """A folder with one table per name: Parquet, or JSON with one object a line."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, rows: DataFrame, form: str = "parquet") -> None:
        rows.write.mode("overwrite").format(form).save(self.path(name))

    def read(self, name: str, schema: str | None = None, form: str = "parquet") -> DataFrame:
        """Blank JSON lines are skipped; a schema keeps Spark from reading the data twice."""
        reader = self.spark.read.format(form)
        return (reader.schema(schema) if schema else reader).load(self.path(name))

    def read_array(self, name: str, schema: str) -> DataFrame:
        """A JSON file that holds one array."""
        return self.spark.read.schema(schema).option("multiLine", True).json(self.path(name))

    def exists(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return bool(place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place))


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """MOT rows `frame,id,x,y,w,h[,conf,...]` with 1-based frames to frame (from 0), track_id, box and confidence (1 where absent).

    Lines that are not at least six numbers are `malformed`; a track that has a frame twice is refused by checked_tracks().
    """
    part = F.split("value", ",")
    at = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("double")
    rows = spark.read.text(path).where(F.trim("value") != "")
    rows = rows.select((at(0).cast("long") - 1).alias("frame"), at(1).cast("long").alias("track_id"), *(at(i + 2).alias(c) for i, c in enumerate("xywh")), F.coalesce(at(6), F.lit(1.0)).alias("confidence"))
    return rows.withColumn("malformed", F.greatest(*(F.col(c).isNull() for c in ("frame", "track_id", "x", "y", "w", "h"))))


def checked_tracks(rows: DataFrame) -> DataFrame:
    """The rows, or an error when the query runs: malformed lines and (track, frame) pairs that come twice are refused."""
    keyed = rows.withColumn("n", F.count("*").over(_window("track_id", "frame")))
    bad = F.col("malformed") | (F.col("n") > 1)
    message = F.concat(F.lit("refused row: track "), F.coalesce(F.col("track_id").cast("string"), F.lit("?")), F.lit(" frame "), F.coalesce(F.col("frame").cast("string"), F.lit("?")))
    return keyed.withColumn("frame", F.when(bad, F.raise_error(message).cast("long")).otherwise(F.col("frame"))).drop("n", "malformed")


def _window(*keys: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def mot_lines(boxes: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Boxes (frame, x, y, w, h, confidence, optional cls) as MOT text: 1-based frames, id -1, two decimals, six for the confidence, in frame order."""
    rows = boxes.where(F.col("cls").isin(classes)) if classes and "cls" in boxes.columns else boxes
    line = F.format_string("%d,-1,%.2f,%.2f,%.2f,%.2f,%.6f", F.col("frame") + 1, "x", "y", "w", "h", "confidence")
    return rows.select("frame", line.alias("value")).orderBy("frame", "value").select("value")


def content_hash(lines: DataFrame) -> DataFrame:
    """An order-independent hash of a set of lines: their number and the sum of their hashes."""
    return lines.agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("h")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("h").cast("string")), 256).alias("sha256"))


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """key and value of lines with an equals sign; sections, comments and others are passed over."""
    rows = spark.read.text(path).where(F.col("value").contains("=") & ~F.trim("value").rlike("^[;#\\[]"))
    part = F.split("value", "=", 2)
    return rows.select(F.trim(part[0]).alias("key"), F.trim(part[1]).alias("value"))


def track_roles(ini: DataFrame) -> DataFrame:
    """`trackletID_7 = player team left;10` to track_id, role, team, jersey; unknown roles are 'other'."""
    text = F.lower("value")
    role = F.when(text.contains("goalkeeper"), "goalkeeper").when(text.contains("player"), "player").when(text.contains("referee"), "referee").when(text.contains("ball"), "ball").otherwise("other")
    team = F.when(text.contains("left"), "left").when(text.contains("right"), "right")
    rows = ini.where(F.lower("key").startswith("trackletid_"))
    return rows.select(F.regexp_extract("key", "_(\\d+)$", 1).cast("long").alias("track_id"), role.alias("role"), team.alias("team"), F.nullif(F.regexp_extract("value", ";\\s*(\\d+)\\s*$", 1), F.lit("")).alias("jersey"))


def with_roles(tracks: DataFrame, roles: DataFrame) -> DataFrame:
    """Track rows with their roles; tracks without one are players of no team."""
    return tracks.join(roles, "track_id", "left").withColumn("role", F.coalesce("role", F.lit("player")))


def unpivot_positions(wide: DataFrame, frame: str = "frame") -> DataFrame:
    """Columns `<team>_<player>_<attribute>` to one row per frame, team and player; rows without a value are left out."""
    names = [c for c in wide.columns if c.count("_") >= 2]
    long = wide.unpivot(frame, names, "name", "value").where("value is not null")
    part = F.split("name", "_")
    long = long.select(frame, part[0].alias("team"), part[1].alias("player"), F.element_at(part, -1).alias("attribute"), "value")
    return long.groupBy(frame, "team", "player").pivot("attribute", sorted({c.rsplit("_", 1)[1] for c in names})).agg(F.first("value"))


def slot_shirts(rows: DataFrame) -> DataFrame:
    """For every slot and frame the shirt last seen there, before the first one the next seen. rows: clip, slot, frame, shirt (null: not seen)."""
    from pyspark.sql import Window

    order = Window.partitionBy("clip", "slot").orderBy("frame")
    back = F.last("shirt", ignorenulls=True).over(order)
    ahead = F.last("shirt", ignorenulls=True).over(Window.partitionBy("clip", "slot").orderBy(F.col("frame").desc()))
    return rows.withColumn("shirt", F.coalesce(back, ahead))


def upsert_manifest(held: DataFrame, new: DataFrame) -> DataFrame:
    """Sequences by name, new entries replacing old ones; a tuning sequence can never change its role: an error when the query runs."""
    old = held.select("name", F.col("role").alias("old_role"))
    both = new.join(old, "name", "left")
    flip = (F.col("old_role") == "tuning") & (F.col("role") != "tuning")
    both = both.withColumn("role", F.when(flip, F.raise_error(F.concat(F.lit("tuning sequence may not change its role: "), F.col("name")))).otherwise(F.col("role"))).drop("old_role")
    return held.join(new.select("name"), "name", "left_anti").unionByName(both).orderBy("name")


def window_starts(first: Column, last: Column, length: int, stride: int) -> Column:
    """Starts of sliding windows that cover first to last, the last window flush with the end."""
    flush = F.greatest(first, last - length + 1)
    return F.array_sort(F.array_union(F.filter(F.sequence(first, F.greatest(first, flush), F.lit(stride)), lambda s: s <= flush), F.array(flush)))


def window_means(windows: DataFrame) -> DataFrame:
    """Overlapping windows' scores averaged per frame. windows: clip, start, scores (one a frame)."""
    rows = windows.select("clip", "start", F.posexplode("scores").alias("i", "score"))
    return rows.groupBy("clip", (F.col("start") + F.col("i")).alias("frame")).agg(F.avg("score").alias("score"), F.count("*").alias("coverage"))

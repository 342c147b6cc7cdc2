"""Position tables of match halves, action lists and labelled clips, as sources of events, tracklets and shirts.

A half's rows are columns: half_key (`<game>_H<half>`), row (its place in the file), frame, player_id, side (0 attacks to the right), shirt,
role (1 to 13), x, y, roi_x, roi_y, roi_w, roi_h (null: off screen), class_id (0: background, null: none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.sources import files

# Roles 1 to 13, the scaling of full-HD boxes to the small video.
ROLES = ["GK", "LB", "LCB", "MCB", "RCB", "LM", "RM", "DM", "AM", "LW", "RW", "CF", "RB"]
SCALE_X, SCALE_Y = 3.0, 3.068181

FPS = 25.0
PLAY_SCHEMA = "keys array<string>, events map<string, array<array<double>>>"
TRUTH_SCHEMA = "source string, sequence string, fps double, kind string, events array<struct<class: string, frame_idx: long, t: double, half: int>>"


def slot_of(side: Column, role: Column) -> Column:
    """Side and role to a slot from 0 to 25; null where either is missing or out of range."""
    return F.when(side.isin(0, 1) & role.between(1, len(ROLES)), G.slot_index(side, role)).cast("int")


def slot_name(slot: Column) -> Column:
    """L or R by side, a dash and the role's letters."""
    side, role = G.slot_side_role(slot)
    return F.concat(F.when(side == 1, "R-").otherwise("L-"), F.element_at(F.array(*(F.lit(r) for r in ROLES)), role))


def club_of(player_id: Column) -> Column:
    """A club's key, the same in both halves, where sides change."""
    return F.floor(player_id / 100).cast("long")


def key_parts(key: Column) -> tuple[Column, Column]:
    """Game and half of a key; half 0 where the key names none."""
    half = F.regexp_extract(key, "_H(\\d+)$", 1).try_cast("int")
    return F.regexp_replace(key, "_H\\d*$", ""), F.coalesce(half, F.lit(0))


def half_keys(rows: DataFrame) -> DataFrame:
    """The halves of a table with their game, number and rows, in order of the key."""
    game, half = key_parts(F.col("half_key"))
    return rows.groupBy("half_key").agg(F.count("*").alias("n_rows")).select("half_key", game.alias("game_id"), half.alias("half"), "n_rows").orderBy("half_key")


def half_events(rows: DataFrame, fps: float = FPS) -> DataFrame:
    """Every labelled row with a slot as an event, on screen or not. A table without class_id is refused: it is an unlabelled split."""
    if "class_id" not in rows.columns:
        raise ValueError("rows have no class_id: an unlabelled split has no events")
    game, half = key_parts(F.col("half_key"))
    slot = slot_of(F.col("side"), F.col("role"))
    rows = rows.where("class_id <> 0").withColumn("slot", slot).where("slot is not null")
    return rows.select(
        "half_key", game.alias("game_id"), half.alias("half"), "row", "frame", "side", "role", "slot", slot_name(F.col("slot")).alias("slot_name"),
        F.coalesce("shirt", F.lit(-1)).cast("long").alias("shirt"), "class_id", F.lit(1.0).alias("score"), (F.col("frame") / fps).alias("t"), F.col("roi_x").isNotNull().alias("has_box"),
    )


def half_tracklets(rows: DataFrame) -> DataFrame:
    """The frames in which a player is on screen, with boxes of the small video, club, and the team of the first such frame."""
    seen = rows.where("roi_x is not null")
    first = F.first("side").over(Window.partitionBy("half_key", "player_id").orderBy("frame", "row"))
    team = F.when(first == 0, "home").when(first == 1, "away").otherwise("unknown")
    right, below = F.col("roi_x") + F.col("roi_w"), F.col("roi_y") + F.col("roi_h")
    return seen.select(
        "half_key", F.col("player_id").alias("tracklet_id"), club_of(F.col("player_id")).alias("club"), "frame", team.alias("team"),
        (F.col("roi_x") / SCALE_X).alias("x1"), (F.col("roi_y") / SCALE_Y).alias("y1"), (right / SCALE_X).alias("x2"), (below / SCALE_Y).alias("y2"),
    )


def with_shirts(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Events of slots with the shirt there: the one last seen up to the event's frame, else the next one seen, else -1.

    Of several rows in one slot and frame the last one counts. events: half_key, row, slot, frame and others.
    """
    seen = rows.withColumn("slot", slot_of(F.col("side"), F.col("role"))).where("slot is not null and shirt is not null and frame >= 0")
    seen = seen.groupBy("half_key", "slot", "frame").agg(F.max_by("shirt", "row").cast("long").alias("_shirt"))
    both = events.drop("shirt").unionByName(seen, allowMissingColumns=True)
    # A sighting has no row: it sorts ahead of the events of its frame.
    order = Window.partitionBy("half_key", "slot").orderBy("frame", F.col("row").asc_nulls_first())
    back = F.last("_shirt", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_shirt", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("shirt", F.coalesce(back, ahead, F.lit(-1))).where("row is not null").drop("_shirt")


def read_plays(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Lists of plays by half: `gt` rows are frame, side, shirt, class, on screen, replay; `pred` rows frame, side, shirt, class, score.

    The fifth number of the one is a flag and of the other a score, so the kind has to be said. Rows under four numbers and halves that `keys` does not name are left out.
    """
    if kind not in ("gt", "pred"):
        raise ValueError(f"kind must be gt or pred, got {kind!r}")
    held = spark.read.schema(PLAY_SCHEMA).option("multiLine", True).json(path).select(F.explode("keys").alias("half_key"), "events")
    rows = held.select("half_key", F.posexplode(F.element_at("events", F.col("half_key"))).alias("row", "v")).where(F.size("v") >= 4)
    at = lambda i: F.try_element_at("v", F.lit(i + 1))
    truth = kind == "gt"
    return rows.select(
        "half_key", "row", *(at(i).cast("long").alias(c) for i, c in enumerate(("frame", "side", "shirt", "class_id"))),
        (F.lit(1.0) if truth else F.coalesce(at(4), F.lit(1.0))).alias("score"),
        (at(4) != 0 if truth else F.lit(None).cast("boolean")).alias("has_box"), (at(5) != 0 if truth else F.lit(None).cast("boolean")).alias("is_replay"),
    )


def with_replays(events: DataFrame, plays: DataFrame) -> DataFrame:
    """Events marked as replays by the labelled play of the same half, frame, side, shirt and class; without one they are live."""
    key = ["half_key", "frame", "side", "shirt", "class_id"]
    flags = plays.groupBy(*key).agg(F.max_by("is_replay", "row").alias("is_replay"))
    return events.join(flags, key, "left").withColumn("is_replay", F.coalesce("is_replay", F.lit(False)))


def is_event_truth(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file holds labelled actions: its kind says so and it has a list of events. Never an error."""
    try:
        kept = spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).json(path)
        return kept.where("kind = 'action_events' and events is not null").count() > 0
    except Exception as refused:  # a missing or unreadable file is no truth
        if "PATH_NOT_FOUND" in str(refused) or "FAILED_READ_FILE" in str(refused):
            return False
        raise


def read_event_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled actions, one row each, from files that is_event_truth() accepts; another kind is an error when the query runs."""
    held = spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).json(path)
    events = F.when(F.col("kind").eqNullSafe("action_events") & F.col("events").isNotNull(), F.col("events")).otherwise(F.raise_error(F.lit("file holds no labelled actions")).cast("array<struct<class: string, frame_idx: long, t: double, half: int>>"))
    rows = held.select("source", "sequence", "fps", F.explode(events).alias("e"))
    return rows.select("source", "sequence", "fps", F.col("e.class").alias("class"), F.col("e.frame_idx").alias("frame"), "e.t", "e.half")


def clip_actions(settings: DataFrame) -> DataFrame:
    """The one labelled action of each clip from its settings (clip, key, value, keys in any case).

    None where it is not visible, its class, position or the clip's start is missing, or it falls outside the clip.
    """
    names = {"name": "string", "framerate": "double", "actionclass": "string", "actionposition": "long", "clipstart": "long", "clipstop": "long", "visibility": "string"}
    row = settings.groupBy("clip").agg(*(F.max(F.when(F.lower("key") == n, F.col("value"))).try_cast(t).alias(n) for n, t in names.items()))
    fps, offset = F.coalesce("framerate", F.lit(FPS)), F.col("actionposition") - F.col("clipstart")
    inside = (offset >= 0) & F.coalesce(F.col("actionposition") <= F.col("clipstop"), F.lit(True))
    usable = row.where(F.col("actionclass").isNotNull() & inside & (F.coalesce("visibility", F.lit("visible")) == "visible"))
    t = offset / 1000
    return usable.select("clip", F.coalesce("name", F.col("clip").cast("string")).alias("sequence"), F.col("actionclass").alias("class"), F.floor(t * fps).cast("long").alias("frame"), F.round(t, 3).alias("t"), fps.alias("fps"))


def read_sequence(spark: SparkSession, folder: str, named: bool = True) -> DataFrame:
    """A sequence's true tracks from gt/gt.txt as corners, with role, team, jersey from gameinfo.ini (named=False: all are players) and frame rate from seqinfo.ini."""
    root = folder.rstrip("/")
    tracks = files.checked_tracks(files.read_mot(spark, f"{root}/gt/gt.txt"))
    if named:
        tracks = files.with_roles(tracks, files.track_roles(files.read_ini(spark, f"{root}/gameinfo.ini")))
    else:
        tracks = tracks.withColumns({"role": F.lit("player"), "team": F.lit(None).cast("string"), "jersey": F.lit(None).cast("string")})
    rate = files.read_ini(spark, f"{root}/seqinfo.ini").agg(F.coalesce(F.max(F.when(F.lower("key") == "framerate", F.col("value"))).try_cast("double"), F.lit(FPS)).alias("fps"))
    corners = tracks.select("frame", "track_id", "role", "team", "jersey", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), "confidence")
    return corners.join(F.broadcast(rate))  # one row


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of files, each read whole."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 8, **options: str) -> DataFrame:
    """A database's table by JDBC; with a numeric key in `parts` ranges at once. The driver's jar has to be on Spark's path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key is not None:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()

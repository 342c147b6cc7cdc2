"""Rosters and naming, causes of switches, refined event times, evidence by channel, label exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.evaluation import greedy
from touchline.operators.pairs import Calibrator


def candidates(tracks: DataFrame) -> DataFrame:
    """Adds `candidate`, `<team>:<number>`, for players and goalkeepers with a side and a number; null for all others."""
    known = F.col("role").isin("player", "goalkeeper") & F.col("team").isNotNull() & F.col("jersey").rlike("^\\d+$")
    return tracks.withColumn("candidate", F.when(known, F.concat_ws(":", "team", "jersey")))


def roster(tracks: DataFrame, by: str = "clip") -> DataFrame:
    """The distinct candidates of each sequence in order; a sequence without any has an empty list."""
    return candidates(tracks).groupBy(by).agg(F.array_sort(F.collect_set("candidate")).alias("roster"))


def naming_report(entities: DataFrame, tracks: DataFrame) -> DataFrame:
    """How well names fit their true tracks, per clip that has a candidate at all.

    entities: clip, entity_id, gt_id (null: not matched), label (null: abstains); tracks: clip, gt_id, role, team, jersey. A name is right as candidate or as its number
    alone; where the true track has no candidate it is not judged. Abstaining lowers coverage, never precision.
    """
    known = candidates(tracks).groupBy("clip", "gt_id").agg(F.max("candidate").alias("candidate"))
    scored = known.groupBy("clip").agg(F.count("candidate").alias("n")).where("n > 0").select("clip")
    rows = entities.where("gt_id is not null").join(known, ["clip", "gt_id"], "left")
    judged = F.col("label").isNotNull() & F.col("candidate").isNotNull()
    right = judged & ((F.col("label") == F.col("candidate")) | (F.col("label") == F.substring_index("candidate", ":", -1)))
    counts = rows.groupBy("clip").agg(F.count("*").alias("n_entities"), F.count("label").alias("n_named"), F.count_if(judged).alias("n_judged"), F.count_if(right).alias("n_correct"))
    out = scored.join(counts, "clip", "left").fillna(0)
    coverage = F.when(F.col("n_entities") > 0, F.col("n_named") / F.col("n_entities")).otherwise(0.0)
    precision = F.when(F.col("n_judged") > 0, F.round(F.col("n_correct") / F.col("n_judged"), 4))
    return out.withColumns({"coverage": F.round(coverage, 4), "abstention": F.round(1 - coverage, 4), "precision": precision})


def remapped(tracklets: DataFrame, layout: DataFrame) -> DataFrame:
    """Tracklet frames counted from 0 back on the source's frames. layout: clip, local, source; a frame outside of it is an error when the query runs."""
    rows = tracklets.join(layout.select("clip", F.col("local").alias("frame"), "source"), ["clip", "frame"], "left")
    message = F.concat(F.lit("tracklet "), F.col("tracklet_id").cast("string"), F.lit(" has a frame outside of the layout: "), F.col("frame").cast("string"))
    return rows.withColumn("frame", F.when(F.col("source").isNull(), F.raise_error(message).cast("long")).otherwise(F.col("source"))).drop("source")


def spotted(events: DataFrame, fps: float = 25.0) -> DataFrame:
    """Derived events in the form of spotted ones: class in capitals, frame, time, confidence, no half."""
    return events.select("clip", F.upper("type").alias("class"), "frame", F.round(F.col("frame") / fps, 3).alias("t"), "confidence", F.lit(None).cast("int").alias("half"))


def refined_timing(corroborated: DataFrame, fps: float = 25.0) -> DataFrame:
    """Events moved to the ball touch that corroborates them; others stay where they are. Keeps the frame before and the shift, null where nothing moved."""
    moved = F.col("touch_frame").isNotNull() & (F.col("touch_frame") != F.col("frame"))
    rows = corroborated.withColumns({"refined_from": F.when(moved, F.col("frame")), "shift": F.when(moved, F.col("touch_frame") - F.col("frame"))})
    rows = rows.withColumn("frame", F.coalesce("touch_frame", "frame"))
    return rows.select("clip", "event_id", "type", "frame", F.round(F.col("frame") / fps, 3).alias("t"), "confidence", "refined_from", "shift")


def corroboration_summary(corroborated: DataFrame, touches: DataFrame) -> DataFrame:
    """All clips in one: counts are added first, rates taken last, so that a short clip weighs as little as it holds.

    `by_type` lists type, events and those with a touch.
    """
    types = corroborated.groupBy("type").agg(F.count("*").alias("n"), F.count("touch_frame").alias("matched"))
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.array_sort(F.collect_list(F.struct("type", "n", "matched"))).alias("by_type"))
    out = total.join(F.broadcast(touches.agg(F.count("*").alias("n_touches"))))  # one row each
    rate = lambda n: F.when(F.col(n) > 0, F.round(F.col("matched") / F.col(n), 4)).otherwise(0.0)
    left = {"possession_only": F.col("n_events") - F.col("matched"), "trajectory_only": F.col("n_touches") - F.col("matched"), "agreement_rate": rate("n_events"), "touch_recall": rate("n_touches")}
    return out.withColumns(left)


def _counterparts(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """The switches of a with the frame of their counterpart among b's on the same subject: nearest first, each used once."""
    keys = ["clip", "gt_id"]
    near = a.select(*keys, "frame").join(b.select(*keys, F.col("frame").alias("at")), keys).where(F.abs(F.col("frame") - F.col("at")) <= tolerance)
    met = greedy(near, keys, [F.abs(F.col("frame") - F.col("at")), F.col("frame"), F.col("at")], "frame", "at")
    return a.join(met.select(*keys, "frame", "at"), [*keys, "frame"], "left")


def switch_attribution(tracklet: DataFrame, entity: DataFrame, oracle: DataFrame | None = None, oracle_input: bool = False, tolerance: int = 25) -> DataFrame:
    """The layer that each switch comes from. Switches: clip, gt_id, frame, ... as switch_instances() gives them.

    Tracklet level: with true boxes as input (oracle_input) online_association; else, held against the switches of a run on true boxes, online_association where the switch persists
    and detection where it does not; without such a run ambiguous. Entity level: the layer of the tracklet switch it goes back to, or offline_association.
    `evidence` says which rule spoke and `at` is the counterpart's frame.
    """
    if oracle_input and oracle is not None:
        raise ValueError("a run on true boxes is not held against another one")
    if oracle is not None:
        low = _counterparts(tracklet, oracle, tolerance)
        layer, evidence = F.when(F.col("at").isNull(), "detection").otherwise("online_association"), F.when(F.col("at").isNull(), "disappears").otherwise("persists")
    else:
        low = tracklet.withColumn("at", F.lit(None).cast("long"))
        layer, evidence = (F.lit("online_association"), F.lit("oracle_input")) if oracle_input else (F.lit("ambiguous"), F.lit("insufficient_evidence"))
    low = low.select("clip", "gt_id", "frame", F.lit("tracklet").alias("level"), layer.alias("layer"), evidence.alias("evidence"), "at")
    causes = low.select("clip", "gt_id", F.col("frame").alias("at"), F.col("layer").alias("cause"))
    high = _counterparts(entity, tracklet, tolerance).join(causes, ["clip", "gt_id", "at"], "left")
    evidence = F.when(F.col("at").isNull(), "entity_only").otherwise("tracklet_counterpart")
    return low.unionByName(high.select("clip", "gt_id", "frame", F.lit("entity").alias("level"), F.coalesce("cause", F.lit("offline_association")).alias("layer"), evidence.alias("evidence"), "at"))


def _by_gap(bins: list[tuple[float, object]], gap: Column, column, rest: Column) -> Column:  # noqa: ANN001
    """The value of the first bin whose upper end exceeds the gap, else `rest`."""
    out = rest
    for high, value in reversed(bins):
        out = F.when(gap < high, column(value)).otherwise(out)
    return out


def channel_scores(pairs: DataFrame, calibrators: dict[str, Calibrator], by_gap: dict[str, list[tuple[float, Calibrator]]] | None = None, weights: dict[str, float] | None = None, weights_by_gap: dict[str, list[tuple[float, float]]] | None = None, required: tuple[str, ...] = (), shrink: float = 0.0) -> DataFrame:
    """Evidence of pairs by channel and in all: raw value, calibrated ratio, weight and what it adds, and their sum.

    pairs: body, occupancy, gap (seconds, below 0 where threads interleave), transition (a ratio already, null without end points), n_frames (of the shorter one, for `shrink`) and others. Calibrators and weights
    may be given by gap, as ascending (upper end, value), before the ones for all gaps. A channel without evidence abstains: its ratio is null and it adds nothing. A pair with no evidence in any
    `required` channel has no score. The gap is read as 0 where threads interleave, and the transition abstains there. The fit's ratios are bounded, and the transition's ratio comes bounded.
    """
    by_gap, weights, weights_by_gap = by_gap or {}, weights or {}, weights_by_gap or {}
    gap = F.greatest(F.lit(0.0), F.col("gap"))
    raw = {"body": F.col("body"), "occupancy": F.col("occupancy"), "gap": gap, "transition": F.when(F.col("transition").isNotNull(), F.col("gap"))}
    nothing = F.lit(None).cast("double")
    ratio = {}
    for name in ("body", "occupancy", "gap"):
        value = raw[name]
        usual = calibrators[name].column(value) if name in calibrators else nothing
        fitted = _by_gap(by_gap.get(name, []), gap, lambda c, v=value: c.column(v), usual)
        ratio[name] = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), fitted)
    ratio["transition"] = F.when((F.col("gap") > 0) & ~F.isnan("transition") & (F.abs("transition") != float("inf")), F.col("transition"))
    bars = [raw[n].isNotNull() & _by_gap([(h, True) for h, _ in by_gap.get(n, [])], gap, F.lit, F.lit(n in calibrators)) for n in required]
    allowed = F.greatest(*bars, F.lit(False)) if bars else F.lit(True)
    channels = []
    for name in raw:
        weight = _by_gap(weights_by_gap.get(name, []), gap, lambda w: F.lit(float(w)), F.lit(float(weights.get(name, 1.0))))
        counted = F.when(allowed, ratio[name])
        added = F.coalesce(weight * counted, F.lit(0.0))
        if name == "occupancy" and shrink > 0:
            added = added * F.col("n_frames") / (F.col("n_frames") + shrink)
        channels.append(F.struct(F.lit(name).alias("name"), raw[name].alias("raw"), counted.alias("llr"), weight.alias("weight"), added.alias("contribution")))
    rows = pairs.withColumn("channels", F.array(*channels))
    total = F.aggregate("channels", F.lit(0.0), lambda s, c: s + c["contribution"])
    return rows.withColumn("score", F.when(allowed, total))


def lab_rows(verdicts: DataFrame, predictions: DataFrame, truth: DataFrame, fps: float = 25.0) -> DataFrame:
    """Each hit, false prediction and missed label with its frames, time and error. A prediction stands at its own frame, a missed label at the label's."""
    p = predictions.select("clip", F.col("event_id").alias("pred_event"), F.col("frame").alias("pred_frame"), "score")
    g = truth.select("clip", F.col("event_id").alias("gt_event"), F.col("frame").alias("gt_frame"), "has_box")
    rows = verdicts.join(p, ["clip", "pred_event"], "left").join(g, ["clip", "gt_event"], "left")
    frame = F.coalesce("pred_frame", "gt_frame")
    return rows.select("clip", "slot", "class_id", "verdict", frame.alias("frame"), F.round(frame / fps, 3).alias("t"), "score", "gt_frame", (F.col("pred_frame") - F.col("gt_frame")).alias("frame_error"), "has_box")


def pair_labels(verdicts: DataFrame) -> DataFrame:
    """Reviewed pairs as training rows: `unsure` is no label and stays out. verdicts: id, kind, verdict and what describes the pair."""
    return verdicts.where("kind = 'pair' and verdict <> 'unsure'").withColumnRenamed("verdict", "label").drop("kind").orderBy("id")


def pair_label_counts(verdicts: DataFrame) -> DataFrame:
    """How many pairs were reviewed, taken and left out as unsure."""
    pairs = verdicts.where("kind = 'pair'")
    return pairs.agg(F.count("*").alias("n_reviewed"), F.count_if(F.col("verdict") != "unsure").alias("n_pairs"), F.count_if(F.col("verdict") == "unsure").alias("n_unsure"))


def example_lines(examples: DataFrame) -> DataFrame:
    """Labelled examples (id, payload as JSON text) as JSON lines with the id among the payload's fields, in order of the id."""
    inner = F.regexp_extract("payload", "(?s)^\\s*\\{(.*)\\}\\s*$", 1)
    line = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.when(F.trim(inner) != "", F.concat(F.lit(", "), F.trim(inner))).otherwise(""), F.lit("}"))
    return examples.orderBy("id").select(line.alias("value"))


def first_free(jobs: DataFrame) -> DataFrame:
    """The job to be done next in each queue: the oldest queued one, by id where equally old. jobs: queue, job_id, status, created."""
    order = Window.partitionBy("queue").orderBy("created", "job_id")
    return jobs.where("status = 'queued'").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")

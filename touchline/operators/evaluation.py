"""Detections, tracks, spotted actions and identities against labelled ones."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators.runs import islands, possession_segments

_BOX = ("x", "y", "w", "h")


def overlaps(dets: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of a detection and a true box of one frame with enough overlap."""
    named = truth.select("clip", "frame", "gt_id", *(F.col(c).alias(f"g{c}") for c in _BOX))
    rows = dets.join(named, ["clip", "frame"])
    rows = rows.withColumn("iou", G.iou([F.col(c) for c in _BOX], [F.col(f"g{c}") for c in _BOX]))
    return rows.where(F.col("iou") >= threshold)


def best_boxes(dets: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For each detection the true box with the most overlap; of equal ones the first."""
    order = Window.partitionBy("clip", "frame", "det_id").orderBy(F.col("iou").desc(), "gt_id")
    return overlaps(dets, truth, threshold).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def match_frames(dets: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy matching per frame: detections by falling confidence take the free true box with the most overlap.

    Every detection with gt_id (null: false), duplicate (false, but over a taken box), and the heights.
    """
    pairs = overlaps(dets, truth, threshold).groupBy("clip", "frame", "det_id").agg(F.collect_list(F.struct("iou", "gt_id", "gh")).alias("pairs"))
    seen = truth.select("clip", "frame").distinct()
    rows = dets.join(seen, ["clip", "frame"], "left_semi").join(pairs, ["clip", "frame", "det_id"], "left").select("clip", "frame", "det_id", "confidence", "h", "pairs")

    def match(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["frame", "confidence", "det_id"], ascending=[True, False, True], ignore_index=True)
        gt, height = [None] * len(group), [None] * len(group)
        duplicate, used = [False] * len(group), set()
        frames = group["frame"].to_numpy()
        each = [[(p["iou"], p["gt_id"], p["gh"]) for p in x] if x is not None else [] for x in group["pairs"]]
        for i, candidates in enumerate(each):
            free = [(-iou, g, h) for iou, g, h in candidates if (frames[i], g) not in used]
            if free:
                _, gt[i], height[i] = min(free)
                used.add((frames[i], gt[i]))
        for i, candidates in enumerate(each):
            duplicate[i] = gt[i] is None and any((frames[i], g) in used for _, g, _ in candidates)
        return pd.DataFrame({"clip": group["clip"], "frame": frames, "det_id": group["det_id"], "confidence": group["confidence"], "h": group["h"], "gt_id": pd.array(gt, dtype="Int64"), "gt_h": pd.array(height, dtype="Float64"), "duplicate": duplicate})

    return rows.groupBy("clip").applyInPandas(match, "clip long, frame long, det_id long, confidence double, h double, gt_id long, gt_h double, duplicate boolean")


def average_precision(flags: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """All-points interpolated AP per key. flags: keys, hit, and `place` in rank order; totals: keys, n_true. 0 without predictions."""
    order = Window.partitionBy(*keys).orderBy("place")
    rows = flags.withColumns({"tp": F.sum(F.col("hit").cast("int")).over(order), "n": F.row_number().over(order)}).withColumn("precision", F.col("tp") / F.col("n"))
    best = F.max("precision").over(Window.partitionBy(*keys).orderBy(F.col("place").desc()))
    hits = rows.withColumn("best", best).where("hit").groupBy(*keys).agg(F.sum("best").alias("area"))
    return totals.join(hits, keys, "left").select(*keys, "n_true", F.round(F.coalesce(F.col("area") / F.col("n_true"), F.lit(0.0)), 4).alias("ap"))


def _ranked(matched: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), "frame", "det_id")
    return matched.select(*keys, F.row_number().over(order).alias("place"), F.col("gt_id").isNotNull().alias("hit"))


def detection_report(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """Per clip: counts, precision, recall, AP, duplicates."""
    n = truth.groupBy("clip").agg(F.count("*").alias("n_true"))
    base = matched.groupBy("clip").agg(F.count("*").alias("n_detections"), F.count("gt_id").alias("n_matched"), F.count(F.when(F.col("duplicate"), 1)).alias("n_duplicates"))
    out = average_precision(_ranked(matched, ["clip"]), n, ["clip"]).join(base, "clip", "left")
    return out.withColumns({"precision": F.round(F.col("n_matched") / F.col("n_detections"), 4), "recall": F.round(F.col("n_matched") / F.col("n_true"), 4)})


def height_bins(matched: DataFrame, truth: DataFrame, edges: tuple[float, ...] = (25.0, 50.0, 100.0)) -> DataFrame:
    """Precision, recall and AP by height: hits and misses by the true height, false detections by their own."""
    place = lambda c: sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0))
    dets = matched.withColumn("bin", place(F.coalesce("gt_h", "h")))
    n = truth.groupBy(place(F.col("h")).alias("bin")).agg(F.count("*").alias("n_true"))
    counts = dets.groupBy("bin").agg(F.count("*").alias("n_detections"), F.count("gt_id").alias("n_matched"))
    out = average_precision(_ranked(dets, ["bin"]), n, ["bin"]).join(counts, "bin", "left")
    return out.withColumns({"precision": F.round(F.col("n_matched") / F.col("n_detections"), 4), "recall": F.round(F.coalesce("n_matched", F.lit(0)) / F.col("n_true"), 4)})


def miss_bursts(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """Runs of a subject's true frames without a matched detection."""
    hit = matched.where("gt_id is not null").select("clip", "frame", "gt_id", F.lit(True).alias("hit"))
    rows = truth.select("clip", "frame", "gt_id").join(hit, ["clip", "frame", "gt_id"], "left").withColumn("missed", F.col("hit").isNull())
    order = Window.partitionBy("clip", "gt_id").orderBy("frame")
    rows = rows.withColumn("burst", F.sum((~F.col("missed")).cast("int")).over(order)).where("missed")
    return rows.groupBy("clip", "gt_id", "burst").agg(F.count("*").alias("length")).drop("burst")


def jitter(matched: DataFrame, dets: DataFrame, truth: DataFrame) -> DataFrame:
    """Between a subject's consecutive true frames that are both matched: how the detection's offset and height changed."""
    boxes = dets.select("clip", "frame", "det_id", *(F.col(c).alias(f"d{c}") for c in _BOX))
    hits = matched.where("gt_id is not null").select("clip", "frame", "gt_id", "det_id").join(boxes, ["clip", "frame", "det_id"])
    rows = truth.join(hits, ["clip", "frame", "gt_id"], "left")
    rx = F.col("dx") + F.col("dw") / 2 - F.col("x") - F.col("w") / 2
    ry = F.col("dy") + F.col("dh") / 2 - F.col("y") - F.col("h") / 2
    order = Window.partitionBy("clip", "gt_id").orderBy("frame")
    rows = rows.withColumns({"rx": rx, "ry": ry, "rh": F.col("dh") - F.col("h")})
    rows = rows.withColumns({f"p{c}": F.lag(c).over(order) for c in ("rx", "ry", "rh")}).where("rx is not null and prx is not null")
    move = G.distance(F.col("prx"), F.col("pry"), F.col("rx"), F.col("ry"))
    return rows.groupBy("clip").agg(F.count("*").alias("n_pairs"), F.round(F.avg(move), 4).alias("center_jitter_mean"), F.round(F.percentile(move, F.lit(0.95)), 4).alias("center_jitter_p95"), F.round(F.avg(F.abs(F.col("rh") - F.col("prh"))), 4).alias("height_jitter_mean"))


def composition(dets: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """How many frames of each tracklet go to each subject, one best box a frame."""
    return best_boxes(dets, truth, threshold).groupBy("clip", "tracklet_id", "gt_id").agg(F.count("*").alias("n"))


def tracklet_purity(dets: DataFrame, truth: DataFrame, threshold: float = 0.5, fps: float = 25.0) -> DataFrame:
    """Per tracklet its length, matched frames, majority subject (of equal ones the lowest id) and purity."""
    lengths = dets.groupBy("clip", "tracklet_id").agg(F.count("*").alias("length"))
    votes = composition(dets, truth, threshold).groupBy("clip", "tracklet_id").agg(F.sum("n").alias("matched_frames"), F.max(F.struct("n", (-F.col("gt_id")).alias("g"))).alias("top"))
    out = lengths.join(votes, ["clip", "tracklet_id"], "left")
    mixed = F.coalesce(F.col("matched_frames") - F.col("top.n"), F.lit(0))
    return out.select(
        "clip", "tracklet_id", "length", F.coalesce("matched_frames", F.lit(0)).alias("matched_frames"), (-F.col("top.g")).alias("majority_gt"), F.round(F.col("top.n") / F.col("matched_frames"), 4).alias("purity"),
        mixed.alias("mixed_frames"), F.round(mixed / fps, 4).alias("mixed_seconds"),
    )


def purity_summary(purity: DataFrame) -> DataFrame:
    """Per clip: frame-weighted purity, share of impure tracklets, quartiles of length (linear between ranks)."""
    quartiles = F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = purity.groupBy("clip").agg(
        F.count("*").alias("n_tracklets"), F.count("purity").alias("n_matched"), F.round(F.sum(F.col("purity") * F.col("matched_frames")) / F.sum(F.when(F.col("purity").isNotNull(), F.col("matched_frames"))), 4).alias("mean_purity"),
        F.round(F.count(F.when(F.col("purity") < 1, 1)) / F.count("purity"), 4).alias("frac_impure"), quartiles.alias("_q"),
    )
    return out.select("*", *(F.round(F.col("_q")[i], 4).alias(n) for i, n in enumerate(("length_p25", "length_median", "length_p75")))).drop("_q")


def tracklet_segments(dets: DataFrame, truth: DataFrame, gap: int = 12, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """Tracklets cut at holes of over `gap` frames, those of at least `least` frames with their majority subject."""
    runs = islands(dets, ["clip", "tracklet_id"], gap)
    sizes = runs.groupBy("clip", "tracklet_id", "run").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("n_frames")).where(F.col("n_frames") >= least)
    votes = best_boxes(runs, truth, threshold).groupBy("clip", "tracklet_id", "run", "gt_id").agg(F.count("*").alias("n"))
    top = votes.groupBy("clip", "tracklet_id", "run").agg(F.max(F.struct("n", (-F.col("gt_id")).alias("g"))).alias("top"), F.sum("n").alias("matched"))
    return sizes.join(top, ["clip", "tracklet_id", "run"]).select("clip", "tracklet_id", "start", "end", (-F.col("top.g")).alias("gt_id"), F.col("top.n").alias("frames"), "matched")


def identity_report(contingency: DataFrame, labels: DataFrame) -> DataFrame:
    """Coverage, purity and completeness of named entities. contingency: entity_id, gt_id, n; labels: entity_id, label (null: unnamed)."""
    rows = contingency.join(labels, "entity_id", "left")
    per = rows.groupBy("entity_id", "label").agg(F.max(F.struct("n", (-F.col("gt_id")).alias("g"))).alias("top"), F.sum("n").alias("mass"))
    named = per.where("label is not null").select("label", (-F.col("top.g")).alias("gt_id"), "mass").groupBy("label", "gt_id").agg(F.sum("mass").alias("mass"))
    by = lambda key: named.groupBy(key).agg(F.max("mass").alias("m"), F.sum("mass").alias("s")).agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    counts = per.agg(F.count("*").alias("n_entities"), F.count("label").alias("n_labeled"), F.countDistinct("label").alias("n_clusters"))
    purity, complete = by("label").select((F.col("m") / F.col("s")).alias("p")), by("gt_id").select((F.col("m") / F.col("s")).alias("c"))
    out = counts.join(F.broadcast(purity)).join(F.broadcast(complete))  # one row each
    return out.select("n_entities", "n_labeled", "n_clusters", F.round(F.col("n_labeled") / F.col("n_entities"), 4).alias("coverage"), F.round("p", 4).alias("cluster_purity"), F.round("c", 4).alias("cluster_completeness"))


def crop_yield(dets: DataFrame, least_height: float = 60.0, least_crops: int = 8) -> DataFrame:
    """Per clip and tracklet, boxes tall enough to crop, and whether there are too few."""
    out = dets.groupBy("clip", "tracklet_id").agg(F.count(F.when(F.col("h") >= least_height, 1)).alias("n_crops"))
    return out.withColumn("starved", F.col("n_crops") < least_crops)


def greedy(candidates: DataFrame, keys: list[str], order: list[Column], left: str, right: str) -> DataFrame:
    """One-to-one matching per key: candidates in a full order, each side used once.

    One template for the matchers, which differ in their order alone. A key's candidates are few: they come from a join within a tolerance.
    """
    ranked = candidates.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def take(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place")
        used_left, used_right, kept = set(), set(), []
        for i, a, b in zip(group.index, group[left], group[right], strict=True):
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                kept.append(i)
        return group.loc[kept]

    return ranked.groupBy(*keys).applyInPandas(take, ranked.schema).drop("_place")


def claim(predictions: DataFrame, truth: DataFrame, keys: list[str], tolerance: float, at: str = "frame", exact: bool = False) -> DataFrame:
    """Every prediction, by falling score, claims the nearest free labelled event of its key within the tolerance (equal distance: the earlier one).

    A group is one value of the first key; the others (at least one) part it. predictions: keys, event_id, score, `at`. Returns keys, event_id, score, gt_event (null: false). Predictions of equal score go by `at`, then event_id;
    with exact=False that is the order in which spotting breaks ties.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in predictions.select(*keys).schema.fields), "event_id long, score double, gt_event long"])
    inner = keys[1:]

    def match(p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([*inner, "score", "event_id"] if exact else [*inner, "score", at, "event_id"], ascending=[True] * len(inner) + ([False, True] if exact else [False, True, True]), ignore_index=True)
        g = g.sort_values([*inner, at, "event_id"], ignore_index=True)
        labelled = {k: (own[at].to_numpy(dtype=float), own["event_id"].to_numpy(), np.ones(len(own), dtype=bool)) for k, own in g.groupby(inner, sort=False)}
        out, times = [], p[at].to_numpy(dtype=float)
        for key, t in zip(p[inner].itertuples(index=False, name=None), times, strict=True):
            at_, ids, free = labelled.get(key, (np.empty(0), None, None))
            away = np.where(free, np.abs(at_ - t), np.inf) if len(at_) else at_
            j = int(away.argmin()) if len(away) else -1
            if j >= 0 and away[j] <= tolerance:
                free[j] = False
                out.append(int(ids[j]))
            else:
                out.append(None)
        return p[[*keys, "event_id", "score"]].assign(gt_event=pd.array(out, dtype="Int64"))

    outer = keys[0]
    return predictions.groupBy(outer).cogroup(truth.withColumnRenamed(outer, f"in_{outer}").groupBy(f"in_{outer}")).applyInPandas(match, schema)


def action_report(predictions: DataFrame, truth: DataFrame, delta: int = 12, least_score: float = 0.15, group: str = "clip") -> DataFrame:
    """Per class: counts, precision, recall and F1. Matching is within clip, slot and class; counts are pooled over clips."""
    sure = predictions.where(F.col("score") >= least_score)
    found = claim(sure, truth, [group, "slot", "class_id"], delta, exact=True)
    hits = found.groupBy("class_id").agg(F.count("*").alias("n_pred"), F.count("gt_event").alias("tp"))
    n = truth.groupBy("class_id").agg(F.count("*").alias("n_gt"))
    out = n.join(hits, "class_id", "full_outer").fillna(0)
    out = out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    return _scores(out)


def _scores(counts: DataFrame) -> DataFrame:
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")).otherwise(0.0)
    out = counts.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def action_summary(per_class: DataFrame) -> DataFrame:
    """Micro scores of the pooled counts and the mean F1 of classes that have labels."""
    total = per_class.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_gt")), F.avg(F.when(F.col("n_gt") > 0, F.col("f1"))).alias("macro_f1"))
    return _scores(total).select("tp", "fp", "fn", "n_gt", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round("f1", 4).alias("micro_f1"), F.round("macro_f1", 4).alias("macro_f1"))


def verdicts(predictions: DataFrame, truth: DataFrame, delta: int = 12, least_score: float = 0.15) -> DataFrame:
    """A row for each hit, false prediction and missed label."""
    found = claim(predictions.where(F.col("score") >= least_score), truth, ["clip", "slot", "class_id"], delta, exact=True)
    hits = found.select("clip", "slot", "class_id", F.when(F.col("gt_event").isNull(), "fp").otherwise("tp").alias("verdict"), F.col("event_id").alias("pred_event"), "gt_event")
    missed = truth.select("clip", "slot", "class_id", F.lit("fn").alias("verdict"), F.lit(None).cast("long").alias("pred_event"), F.col("event_id").alias("gt_event"))
    missed = missed.join(found.where("gt_event is not null").select("clip", "gt_event"), ["clip", "gt_event"], "left_anti")
    return hits.unionByName(missed)


def average_map(predictions: DataFrame, truth: DataFrame, tolerances: tuple[float, ...]) -> DataFrame:
    """Mean AP over labelled classes for each tolerance (frames); their mean is the headline."""
    parts = []
    n = truth.groupBy("class_id").agg(F.count("*").alias("n_true"))
    for tolerance in tolerances:
        found = claim(predictions, truth, ["clip", "class_id"], tolerance)
        order = Window.partitionBy("class_id").orderBy(F.col("score").desc(), "clip", "event_id")
        flags = found.select("class_id", F.row_number().over(order).alias("place"), F.col("gt_event").isNotNull().alias("hit"))
        parts.append(average_precision(flags, n, ["class_id"]).agg(F.lit(float(tolerance)).alias("tolerance"), F.round(F.avg("ap"), 4).alias("map")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def fused_models(models: list[DataFrame], delta: int = 12, least_models: int = 2, solo_classes: tuple[int, ...] = ()) -> DataFrame:
    """Clusters of several models' actions of one clip, slot and class: seeds by falling score take one event a model within delta.

    A cluster needs least_models unless its class is exempt; its score is the mean times the root of the models' share.
    """
    n = len(models)
    rows = models[0].withColumn("model", F.lit(0))
    for i, df in enumerate(models[1:], 1):
        rows = rows.unionByName(df.withColumn("model", F.lit(i)))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "model", "frame", "event_id"], ascending=[False, True, True, True], ignore_index=True)
        frame, model, score = group["frame"].to_numpy(), group["model"].to_numpy(), group["score"].to_numpy()
        taken, out = np.zeros(len(group), dtype=bool), []
        for i in range(len(group)):
            if taken[i]:
                continue
            taken[i], members, used = True, [i], {model[i]}
            for j in range(len(group)):
                if not taken[j] and model[j] not in used and abs(frame[j] - frame[i]) <= delta:
                    taken[j] = True
                    members.append(j)
                    used.add(model[j])
            if len(used) >= least_models or group["class_id"][i] in solo_classes:
                out.append((group["clip"][i], group["slot"][i], group["class_id"][i], frame[i], float(score[members].mean() * (len(used) / n) ** 0.5), len(used)))
        return pd.DataFrame(out, columns=["clip", "slot", "class_id", "frame", "score", "n_models"])

    return rows.groupBy("clip", "slot", "class_id").applyInPandas(cluster, "clip long, slot int, class_id int, frame long, score double, n_models int")


def event_corroboration(events: DataFrame, touches: DataFrame, tolerance: int = 6, bonus: float = 0.15, penalty: float = 0.25) -> DataFrame:
    """Events matched one to one with ball touches by distance, then touch score, then event; confidence goes up or down."""
    t = touches.select("clip", F.col("frame").alias("touch_frame"), F.col("score").alias("touch_score"))
    near = events.select("clip", "event_id", "frame").join(t, "clip").where(F.abs(F.col("frame") - F.col("touch_frame")) <= tolerance)
    order = [F.abs(F.col("frame") - F.col("touch_frame")), F.col("touch_score").desc(), F.col("event_id"), F.col("touch_frame")]
    matched = greedy(near, ["clip"], order, "event_id", "touch_frame").select("clip", "event_id", "touch_frame", "touch_score")
    out = events.join(matched, ["clip", "event_id"], "left")
    adjusted = F.when(F.col("touch_frame").isNull(), F.greatest(F.lit(0.0), F.col("confidence") - penalty)).otherwise(F.least(F.lit(1.0), F.col("confidence") + bonus))
    return out.withColumns({"adjusted_confidence": F.round(adjusted, 4), "refined_frame": F.coalesce("touch_frame", "frame")})


def switch_instances(matches: DataFrame) -> DataFrame:
    """Each change of a subject's matched id. matches: clip, gt_id, frame, hyp_id."""
    order = Window.partitionBy("clip", "gt_id").orderBy("frame")
    rows = matches.withColumn("before", F.lag("hyp_id").over(order)).where("before <> hyp_id")
    return rows.select("clip", "gt_id", "frame", F.col("before").alias("from_id"), F.col("hyp_id").alias("to_id"))


def switch_diff(a: DataFrame, b: DataFrame, tolerance: int = 25) -> DataFrame:
    """Switches of two runs matched per subject by distance in time: persisted, fixed (only in a) or introduced (only in b)."""
    x = a.select("clip", "gt_id", F.col("frame").alias("a_frame"))
    y = b.select("clip", "gt_id", F.col("frame").alias("b_frame"))
    near = x.join(y, ["clip", "gt_id"]).where(F.abs(F.col("a_frame") - F.col("b_frame")) <= tolerance)
    matched = greedy(near, ["clip", "gt_id"], [F.abs(F.col("a_frame") - F.col("b_frame")), F.col("a_frame"), F.col("b_frame")], "a_frame", "b_frame").select("clip", "gt_id", "a_frame", "b_frame")
    fixed = x.join(matched, ["clip", "gt_id", "a_frame"], "left_anti").select("clip", "gt_id", F.col("a_frame").alias("frame"), F.lit("fixed").alias("outcome"))
    introduced = y.join(matched, ["clip", "gt_id", "b_frame"], "left_anti").select("clip", "gt_id", F.col("b_frame").alias("frame"), F.lit("introduced").alias("outcome"))
    return matched.select("clip", "gt_id", F.col("a_frame").alias("frame"), F.lit("persisted").alias("outcome")).unionByName(fixed).unionByName(introduced)


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of least total cost, by shortest augmenting paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[at] = True
            i = owner[at]
            reduced = c[i - 1] - u[i] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            back[1:][better] = at
            step_to = int(np.where(done[1:], np.inf, least[1:]).argmin()) + 1
            step = least[step_to]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = step_to
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    rows = np.array([owner[j] - 1 for j in range(1, m + 1) if owner[j]])
    columns = np.array([j - 1 for j in range(1, m + 1) if owner[j]])
    rows, columns = (columns, rows) if turned else (rows, columns)
    order = rows.argsort(kind="stable")
    return rows[order], columns[order]


def hota(dets: DataFrame, truth: DataFrame, hypothesis: str = "tracklet_id") -> DataFrame:
    """HOTA, DetA, AssA and LocA per clip, averaged over the localisation thresholds 0.05 to 0.95."""
    a = truth.select("clip", "frame", F.col("gt_id").alias("id"), *_BOX, F.lit(0).alias("side"))
    b = dets.select("clip", "frame", F.col(hypothesis).alias("id"), *_BOX, F.lit(1).alias("side"))
    names = ("HOTA", "DetA", "AssA", "LocA")

    def score(group: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for _, rows in group.groupby("frame", sort=True):
            g, h = rows[rows["side"] == 0], rows[rows["side"] == 1]
            gb, hb = g[list(_BOX)].to_numpy(), h[list(_BOX)].to_numpy()
            low, high = np.maximum(gb[:, None, :2], hb[None, :, :2]), np.minimum(gb[:, None, :2] + gb[:, None, 2:], hb[None, :, :2] + hb[None, :, 2:])
            inter = np.clip(high - low, 0, None).prod(axis=2)
            union = gb[:, None, 2:].prod(axis=2) + hb[None, :, 2:].prod(axis=2) - inter
            frames.append((g["id"].to_numpy(), h["id"].to_numpy(), np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)))
        gt, hyp = np.unique(group.loc[group["side"] == 0, "id"]), np.unique(group.loc[group["side"] == 1, "id"])
        if not len(gt) or not len(hyp):
            return pd.DataFrame([[group["clip"].iloc[0], 0.0, 0.0, 0.0, 0.0 if len(gt) else 1.0]], columns=["clip", *names])
        shared, n_gt, n_hyp = np.zeros((len(gt), len(hyp))), np.zeros(len(gt)), np.zeros(len(hyp))
        for g, h, s in frames:
            i, j = np.searchsorted(gt, g), np.searchsorted(hyp, h)
            n_gt[i] += 1
            n_hyp[j] += 1
            rest = s.sum(axis=0)[None, :] + s.sum(axis=1)[:, None] - s
            shared[np.ix_(i, j)] += np.divide(s, rest, out=np.zeros_like(s), where=rest > 0)
        alignment = shared / (n_gt[:, None] + n_hyp[None, :] - shared)
        alphas = np.arange(0.05, 0.99, 0.05)
        at_gt, at_hyp, near = [], [], []
        for g, h, s in frames:
            if len(g) and len(h):
                i, j = np.searchsorted(gt, g), np.searchsorted(hyp, h)
                r, c = hungarian(-(alignment[np.ix_(i, j)] * s))
                at_gt.append(i[r])
                at_hyp.append(j[c])
                near.append(s[r, c])
        at_gt, at_hyp, near = (np.concatenate(v) if v else np.empty(0, dtype=int) for v in (at_gt, at_hyp, near))
        tp, loc, pairs = np.zeros(len(alphas)), np.zeros(len(alphas)), []
        for k, alpha in enumerate(alphas):
            ok = near >= alpha - np.finfo(float).eps
            tp[k], loc[k] = ok.sum(), near[ok].sum()
            pairs.append(np.bincount(at_gt[ok] * len(hyp) + at_hyp[ok], minlength=len(gt) * len(hyp)).reshape(len(gt), len(hyp)).astype(float))
        total = n_gt.sum() + n_hyp.sum()
        det = tp / np.maximum(1, total - tp)
        ass = np.array([(p * (p / np.maximum(1, n_gt[:, None] + n_hyp[None, :] - p))).sum() / max(1, t) for p, t in zip(pairs, tp, strict=True)])
        located = np.where(tp > 0, loc / np.maximum(1, tp), 1.0)
        return pd.DataFrame([[group["clip"].iloc[0], np.sqrt(det * ass).mean(), det.mean(), ass.mean(), located.mean()]], columns=["clip", *names])

    return a.unionByName(b).groupBy("clip").applyInPandas(score, "clip long, HOTA double, DetA double, AssA double, LocA double")


def possession_localisation(timeline: DataFrame, actions: DataFrame) -> DataFrame:
    """For each labelled action, the nearest boundary of a possession segment and how many frames away it is."""
    ends = possession_segments(timeline).select("clip", F.explode(F.array("start", "end")).alias("boundary"))
    near = actions.join(ends, "clip").groupBy("clip", "event_id", "frame").agg(F.min(F.struct(F.abs(F.col("boundary") - F.col("frame")).alias("error"), "boundary")).alias("best"))
    return near.select("clip", "event_id", "frame", F.col("best.boundary").alias("predicted"), F.col("best.error").alias("error_frames"))



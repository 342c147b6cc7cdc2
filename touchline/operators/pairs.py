"""Pairs of tracklets: gates, likeness, merging, retrieval, names. A clip is a group; pairs are formed within it after the cheap gates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G

LOG_BOUND = 6.0


def pairs(tracklets: DataFrame) -> DataFrame:
    """Every unordered pair of a clip, `first` being the one that starts first (of equal starts the lower id)."""
    side = lambda p: tracklets.select("clip", *(F.col(c).alias(f"{p}_{c}") for c in tracklets.columns if c != "clip"))
    a, b = side("a"), side("b")
    early = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_tracklet_id") < F.col("b_tracklet_id")))
    return a.join(b, "clip").where(early)


def overlap_reason(tolerance: int = 2) -> Column:
    return F.when(F.col("b_start") - F.col("a_end") < -tolerance, "temporal_overlap")


def team_reason(least_confidence: float = 0.0) -> Column:
    """Only two known, trusted and different teams forbid a pair; a missing confidence is trusted. a_confidence and b_confidence are read if least_confidence is above 0."""
    differ = F.col("a_team") != F.col("b_team")
    if least_confidence > 0:
        for side in ("a", "b"):
            differ &= F.coalesce(F.col(f"{side}_confidence") >= least_confidence, F.lit(True))
    return F.when(differ, "team_mismatch")


def anchor_reason() -> Column:
    return F.when(F.col("a_anchor") != F.col("b_anchor"), "anchor_conflict")


def motion_reason(fps: float = 25.0, limit: float = 800.0, soft_gap_s: float = 15.0, metric_limit: float = 900.0, calibration: tuple[Column, Column] | None = None, camera: Column | None = None) -> Column:
    """Too fast from where one ended (end_x, end_y) to where the other begins (start_x, start_y), for gaps up to soft_gap_s.

    calibration: the homographies onto the pitch at the one's end and the other's start; where both are known, metric_limit (cm/s) alone
    counts, there. Else limit (pixels/s) counts, from where camera, the homography from the one's last frame to the other's first, puts the end if it is known.
    """
    gap = (F.col("b_start") - F.col("a_end")) / fps
    end, start = (F.col("a_end_x"), F.col("a_end_y")), (F.col("b_start_x"), F.col("b_start_y"))
    seen = end
    if camera is not None:
        seen = tuple(F.when(camera.isNotNull(), moved).otherwise(still) for moved, still in zip(G.project(camera, *end), end, strict=True))
    far = G.distance(*seen, *start) > limit * gap
    if calibration is not None:
        metric = G.distance(*G.project(calibration[0], *end), *G.project(calibration[1], *start)) > metric_limit * gap
        far = F.when(calibration[0].isNotNull() & calibration[1].isNotNull(), metric).otherwise(far)
    return F.when((gap > 0) & (gap <= soft_gap_s) & far, "motion_infeasible")


def gated(rows: DataFrame, reasons: list[Column]) -> DataFrame:
    """Adds reason: the first gate that refuses the pair, or null."""
    return rows.withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null without a length."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size > 0, size)


def scored_pairs(tracklets: DataFrame, reasons: list[Column] | None = None) -> DataFrame:
    """Pairs that pass the gates, with `score`, the cosine of their embeddings (double precision)."""
    keep = [c for c in tracklets.columns if c != "embedding"]
    rows = gated(pairs(tracklets.select(*keep)), reasons or [overlap_reason(), team_reason()]).where("reason is null")
    vectors = tracklets.select("clip", "tracklet_id", "embedding")
    rows = rows.join(vectors.select("clip", F.col("tracklet_id").alias("a_tracklet_id"), F.col("embedding").alias("a_embedding")), ["clip", "a_tracklet_id"])
    rows = rows.join(vectors.select("clip", F.col("tracklet_id").alias("b_tracklet_id"), F.col("embedding").alias("b_embedding")), ["clip", "b_tracklet_id"])
    rows = rows.withColumn("score", cosine(F.col("a_embedding"), F.col("b_embedding"))).drop("a_embedding", "b_embedding").where("score is not null")
    low, high = F.least("a_tracklet_id", "b_tracklet_id"), F.greatest("a_tracklet_id", "b_tracklet_id")
    return rows.withColumns({"a": low, "b": high})


def both_ways(scored: DataFrame) -> DataFrame:
    """Each pair seen from either side: clip, item, partner, score and whether both have one label."""
    same = F.col("a_label") == F.col("b_label")
    a, b = F.col("a_tracklet_id"), F.col("b_tracklet_id")
    sides = F.array(F.struct(a.alias("item"), b.alias("partner")), F.struct(b.alias("item"), a.alias("partner")))
    return scored.select("clip", "score", same.alias("same"), F.inline(sides))


def mutual_best(scored: DataFrame, least_margin: float = 0.0) -> DataFrame:
    """Pairs that are each other's best, with a margin over either's second best of at least least_margin. Ranks are over all gated pairs."""
    order = Window.partitionBy("clip", "item").orderBy(F.col("score").desc(), "partner")
    ranked = both_ways(scored).withColumns({"rank": F.row_number().over(order), "margin": F.col("score") - F.lead("score").over(order)}).where("rank = 1")
    x = ranked.select("clip", F.col("item").alias("a"), F.col("partner").alias("b"), "score", "same", F.col("margin").alias("ma"))
    y = ranked.select("clip", F.col("item").alias("b"), F.col("partner").alias("a"), F.col("margin").alias("mb"))
    both = x.join(y, ["clip", "a", "b"]).where("a < b")
    fine = F.least(F.coalesce("ma", F.lit(math.inf)), F.coalesce("mb", F.lit(math.inf))) >= least_margin
    return both.where(fine).select("clip", "a", "b", "score", "same")


def merge_counts(admitted: DataFrame, thresholds: list[float]) -> DataFrame:
    """Right and wrong merges at each threshold."""
    rows = admitted.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("score >= threshold")
    return rows.groupBy("threshold").agg(F.count(F.when(F.col("same"), 1)).alias("correct"), F.count(F.when(~F.col("same"), 1)).alias("wrong"))


def merge_curve(admitted: DataFrame) -> DataFrame:
    """Cumulative right and wrong merges of each clip by falling score."""
    order = Window.partitionBy("clip").orderBy(F.col("score").desc(), "a", "b").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.sum(c.cast("int")).over(order)
    return admitted.select("clip", "a", "b", F.round("score", 6).alias("score"), count(F.col("same")).alias("correct"), count(~F.col("same")).alias("wrong"))


def budget_curve(counts: DataFrame, budgets: list[int]) -> DataFrame:
    """For each budget of wrong merges, the threshold with most right ones (then fewest wrong, then lowest); null if none is affordable."""
    spine = counts.sparkSession.createDataFrame([(b,) for b in budgets], "budget int")
    best = F.max(F.struct("correct", (-F.col("wrong")).alias("w"), (-F.col("threshold")).alias("t")))
    found = counts.join(F.broadcast(spine)).where("wrong <= budget").groupBy("budget").agg(best.alias("x"))  # a few budgets
    out = spine.join(found, "budget", "left")
    return out.select("budget", F.coalesce("x.correct", F.lit(0)).alias("correct"), F.coalesce(-F.col("x.w"), F.lit(0)).alias("wrong"), (-F.col("x.t")).alias("threshold"))


def error_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Wrong merges of two methods: shared, Jaccard, and only in one."""
    x = a.where("not same").select("clip", "a", "b", F.lit(1).alias("in_a"))
    y = b.where("not same").select("clip", "a", "b", F.lit(1).alias("in_b"))
    rows = x.join(y, ["clip", "a", "b"], "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return rows.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), n(both).alias("n_shared"), F.round(F.coalesce(n(both) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("jaccard"), n(F.col("in_b").isNull()).alias("only_a"), n(F.col("in_a").isNull()).alias("only_b"))


def merge_tracklets(tracklets: DataFrame, candidates: DataFrame, tolerance: int = 2) -> DataFrame:
    """Ordered union-find per clip: candidates (clip, a, b, score, optional tier) by tier, falling score, a, b; spans of a merged group must not overlap by more than the tolerance.

    Not connected components: a refused pair stays refused. Returns clip, tracklet_id, thread_id (the smallest member).
    """
    if "tier" not in candidates.columns:
        candidates = candidates.withColumn("tier", F.lit(1))

    def merge(key: tuple, spans: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        group = {int(t): int(t) for t in spans["tracklet_id"]}
        members = {int(t): [(int(s), int(e), int(t))] for t, s, e in zip(spans["tracklet_id"], spans["start"], spans["end"], strict=True)}
        edges = edges.sort_values(["tier", "score", "a", "b"], ascending=[True, False, True, True])
        for a, b in zip(edges["a"], edges["b"], strict=True):
            x, y = group[int(a)], group[int(b)]
            if x == y or any(min(e1, e2) - max(s1, s2) > tolerance for s1, e1, _ in members[x] for s2, e2, _ in members[y]):
                continue
            members[x] += members.pop(y)
            for _, _, t in members[x]:
                group[t] = x
        small = {x: min(t for _, _, t in m) for x, m in members.items()}
        return pd.DataFrame({"clip": [key[0]] * len(group), "tracklet_id": list(group), "thread_id": [small[x] for x in group.values()]}, columns=["clip", "tracklet_id", "thread_id"]).astype("int64")

    return tracklets.select("clip", "tracklet_id", "start", "end").groupBy("clip").cogroup(candidates.select(F.col("clip").alias("in_clip"), "a", "b", "score", "tier").groupBy("in_clip")).applyInPandas(merge, "clip long, tracklet_id long, thread_id long")


def episodes(tracklets: DataFrame, same_team: bool = True) -> DataFrame:
    """Each tracklet with the later ones of its clip (and team) as candidates: how many, and how many are the same identity."""
    q = tracklets.select("clip", F.col("tracklet_id").alias("query"), F.col("end").alias("q_end"), F.col("team").alias("q_team"), F.col("label").alias("q_label"))
    c = tracklets.select("clip", "tracklet_id", "start", "team", "label")
    rows = q.join(c, "clip").where("start > q_end")
    rows = rows.where("team = q_team") if same_team else rows
    return rows.groupBy("clip", "query").agg(F.count("*").alias("n_candidates"), F.count(F.when(F.col("label") == F.col("q_label"), 1)).alias("n_correct"))


def retrieval(scored: DataFrame) -> DataFrame:
    """Per query with a true partner: whether the best is right, its margin, and average precision."""
    order = Window.partitionBy("clip", "item").orderBy(F.col("score").desc(), "partner")
    rows = both_ways(scored).withColumns({"rank": F.row_number().over(order), "margin": F.col("score") - F.lead("score").over(order), "hits": F.sum(F.col("same").cast("int")).over(order)})
    out = rows.groupBy("clip", "item").agg(
        F.count("*").alias("n_candidates"), F.sum(F.col("same").cast("int")).alias("n_true"), F.max(F.when(F.col("rank") == 1, F.col("same"))).alias("top1_correct"),
        F.round(F.max(F.when(F.col("rank") == 1, F.col("margin"))), 6).alias("margin"), F.round(F.avg(F.when(F.col("same"), F.col("hits") / F.col("rank"))), 6).alias("average_precision"),
    )
    return out.where("n_true > 0")


def retrieval_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count("*").alias("n_scored"), F.round(F.avg(F.col("top1_correct").cast("int")), 4).alias("rank1"), F.round(F.avg("average_precision"), 4).alias("map"))


def retrieval_breakdown(outcomes: DataFrame, bins: list[tuple[str, float, float]], by: str = "n_candidates") -> DataFrame:
    """Rank-1 by half-open bins of a column."""
    return outcomes.withColumn("bin", G.length_bucket(F.col(by), bins)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("top1_correct").cast("int")), 4).alias("rank1"))


def impostor_llr(scored: DataFrame) -> DataFrame:
    """Each candidate's score against its episode's others: margin over the best of them in their standard deviations, bounded."""
    rows = both_ways(scored)
    every = Window.partitionBy("clip", "item")
    n = F.count("*").over(every) - 1
    order = Window.partitionBy("clip", "item").orderBy(F.col("score").desc(), "partner")
    first, second = F.first("score").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.max(F.when(F.col("rank") == 2, F.col("score"))).over(every)
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumns({"n": n, "s1": F.sum("score").over(every) - F.col("score"), "s2": F.sum(F.col("score") * F.col("score")).over(every) - F.col("score") * F.col("score"), "first": first, "second": second})
    rival = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2))).otherwise(F.when(rival == 0, 1.0).otherwise(F.abs(rival)))
    llr = F.when(F.col("n") < 1, 0.0).otherwise(F.greatest(F.lit(-LOG_BOUND), F.least(F.lit(LOG_BOUND), (F.col("score") - rival) / F.greatest(spread, F.lit(1e-6)))))
    return rows.select("clip", "item", "partner", llr.alias("llr"))


def decode_names(threads: DataFrame, anchors: DataFrame, roster: list[str], least_posterior: float = 0.6, least_margin: float = 0.2, tolerance: int = 2) -> DataFrame:
    """Names for threads from summed evidence: softmax over the roster, then the surest thread first; a name is not given twice to overlapping spans.

    threads: clip, thread_id, start, end (one row a span); anchors: clip, thread_id, candidate, log_lr. Threads without evidence abstain.
    """
    index = {c: i for i, c in enumerate(roster)}
    schema = "clip long, thread_id long, label string, posterior double, margin double"

    def decode(key: tuple, spans: pd.DataFrame, evidence: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(spans["thread_id"].unique())
        belief, known = np.zeros((len(ids), len(roster))), np.zeros(len(ids), dtype=bool)
        for t, c, v in zip(evidence["thread_id"], evidence["candidate"], evidence["log_lr"], strict=True):
            if c in index and t in ids:
                belief[ids.index(t), index[c]] += v
                known[ids.index(t)] = True
        p = np.exp(belief - belief.max(axis=1, keepdims=True)) if roster else belief
        p = p / p.sum(axis=1, keepdims=True) if roster else p
        out, taken = {}, []
        for i in np.argsort(-p.max(axis=1), kind="stable") if roster else range(len(ids)):
            label = margin = top = None
            if roster:
                ranked = np.argsort(-p[i], kind="stable")
                top = float(p[i, ranked[0]])
                margin = top - float(p[i, ranked[1]]) if len(roster) > 1 else top
                own = spans.loc[spans["thread_id"] == ids[i], ["start", "end"]].to_numpy()
                for c in ranked if known[i] else []:
                    if p[i, c] < least_posterior or margin < least_margin:
                        break
                    if not any(held == c and any(min(e1, e2) - max(s1, s2) > tolerance for s1, e1 in own for s2, e2 in theirs) for held, theirs in taken):
                        label = roster[c]
                        taken.append((c, own))
                        break
            out[ids[i]] = (key[0], ids[i], label, top, margin)
        return pd.DataFrame([out[t] for t in ids], columns=["clip", "thread_id", "label", "posterior", "margin"])

    return threads.groupBy("clip").cogroup(anchors.withColumnRenamed("clip", "in_clip").groupBy("in_clip")).applyInPandas(decode, schema)


def with_tiers(names: DataFrame, least_posterior: float = 0.85, least_margin: float = 0.5) -> DataFrame:
    """auto_accept for sure names, qa for all others."""
    sure = F.col("label").isNotNull() & (F.col("posterior") >= least_posterior) & (F.coalesce("margin", F.lit(0.0)) >= least_margin)
    return names.withColumn("tier", F.when(sure, "auto_accept").otherwise("qa"))


class Calibrator:
    """A monotone log-likelihood ratio of a score: a logistic backbone and a smoothed, shrunk, isotonic correction of its bins."""

    def __init__(self, slope: float, intercept: float, knots: np.ndarray, correction: np.ndarray) -> None:
        self.slope, self.intercept, self.knots, self.correction = slope, intercept, knots, correction

    @classmethod
    def fit(cls, scored: DataFrame, most_bins: int = 20) -> Calibrator:
        """From pairs with score and same: quantile edges and bin counts are aggregated, only those come to the driver."""
        n_same, n_diff = scored.agg(F.count(F.when(F.col("same"), 1)), F.count(F.when(~F.col("same"), 1))).first()
        bins = int(np.clip((n_same + n_diff) // 100, 4, most_bins))
        edges = np.unique(scored.select(F.percentile("score", F.array(*(F.lit(i / bins) for i in range(bins + 1))))).first()[0])
        if len(edges) < 3:
            edges = np.linspace(edges[0] - 1e-6, edges[-1] + 1e-6, 3)
        place = sum((F.when(F.col("score") >= float(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
        counts = np.zeros((2, len(edges) - 1))
        moments = scored.groupBy(place.alias("bin"), "same").agg(F.count("*").alias("n")).collect()
        for r in moments:
            counts[int(not r["same"]), r["bin"]] += r["n"]
        slope, intercept = _logistic_of_bins(scored)
        intercept -= math.log(max(n_same, 1) / max(n_diff, 1))
        centres = (edges[:-1] + edges[1:]) / 2
        same, diff = (counts + 1) / (counts.sum(axis=1, keepdims=True) + counts.shape[1])
        backbone = slope * centres + intercept
        raw = np.log(same / diff) - backbone
        smooth = np.convolve(np.pad(raw, 1, mode="edge"), [0.25, 0.5, 0.25], mode="valid")
        weight = counts.sum(axis=0) / (counts.sum(axis=0) + 10)
        combined = backbone + weight * smooth
        turn = slice(None) if slope >= 0 else slice(None, None, -1)
        x, y = isotonic(combined[turn], counts.sum(axis=0)[turn], centres[turn])
        return cls(slope, intercept, x[turn], (y - (slope * x + intercept))[turn])

    def column(self, score: Column) -> Column:
        """The bounded ratio as a column: linear between knots."""
        out = F.lit(float(self.correction[-1]))
        for i in reversed(range(len(self.knots) - 1)):
            x0, x1, y0, y1 = (float(v) for v in (self.knots[i], self.knots[i + 1], self.correction[i], self.correction[i + 1]))
            out = F.when(score < x1, y0 + (score - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
        out = F.when(score <= float(self.knots[0]), float(self.correction[0])).otherwise(out)
        return G.saturated(self.slope * score + self.intercept + out, LOG_BOUND)


def _logistic_of_bins(scored: DataFrame, rounds: int = 25) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton's method; each round is one aggregation of five sums."""
    mean, spread = scored.agg(F.avg("score"), F.stddev_pop("score")).first()
    spread = spread or 1.0
    z = (F.col("score") - mean) / spread
    w = np.zeros(2)
    for _ in range(rounds):
        p = G.logistic(z * float(w[0]) + float(w[1]))
        miss, v = F.col("same").cast("double") - p, p * (1 - p)
        g0, g1, h00, h01, h11 = scored.agg(F.sum(miss * z), F.sum(miss), F.sum(v * z * z), F.sum(v * z), F.sum(v)).first()
        step = np.linalg.solve(np.array([[h00, h01], [h01, h11]]) + 1e-9 * np.eye(2), [g0, g1])
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def isotonic(values: np.ndarray, weights: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: positions and values of the rising blocks, both weighted means."""
    blocks: list[tuple[float, float, float]] = []
    for y, w, x in zip(values, np.maximum(weights, 1e-9), positions, strict=True):
        block = (y * w, w, x * w)
        while blocks and blocks[-1][0] / blocks[-1][1] > block[0] / block[1]:
            block = tuple(a + b for a, b in zip(blocks.pop(), block, strict=True))
        blocks.append(block)
    table = np.array(blocks)
    return table[:, 2] / table[:, 1], table[:, 0] / table[:, 1]

"""Association of tracklets into threads: part-based likeness, re-ranking, learned weights, global and two-pass merging, and how good it is."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators import evaluation as E
from touchline.operators.evaluation import hungarian
from touchline.operators.pairs import both_ways


def representations(frames: DataFrame, most: int = 4, view: float = 0.7) -> DataFrame:
    """At most `most` prototypes a tracklet, grown from its frames by falling quality: a frame joins the nearest prototype if that is near enough or there is no room.

    frames: clip, tracklet_id, frame, parts (array of part vectors), visibility (one a part). Returns clip, tracklet_id, prototype, parts, visibility, n_frames, starved.
    """
    schema = "clip long, tracklet_id long, prototype int, parts array<array<double>>, visibility array<double>, n_frames int, starved boolean"

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame")
        x = np.array([np.stack(p) for p in group["parts"]], dtype=float)
        seen = np.array([np.asarray(v, dtype=float) for v in group["visibility"]])
        quality = np.linalg.norm(x.reshape(len(x), -1), axis=1)
        held: list[list] = []  # weighted sum of parts, of visibility, weight, frames
        for i in np.argsort(-quality, kind="stable"):
            if quality[i] <= 0:
                continue
            if held:
                centres = np.stack([s.ravel() / w for s, _, w, _ in held])
                length = np.linalg.norm(centres, axis=1)
                near = centres @ (x[i].ravel() / quality[i]) / np.where(length > 0, length, 1)
                j = int(near.argmax())
                if near[j] >= view or len(held) >= most:
                    s, v, w, n = held[j]
                    held[j] = [s + quality[i] * x[i], v + quality[i] * seen[i], w + quality[i], n + 1]
                    continue
            held.append([quality[i] * x[i], quality[i] * seen[i], quality[i], 1])
        rows = [(group["clip"].iloc[0], group["tracklet_id"].iloc[0], k, (s / w).tolist(), (v / w).tolist(), n, int((quality > 0).sum()) <= 2) for k, (s, v, w, n) in enumerate(held)]
        return pd.DataFrame(rows, columns=["clip", "tracklet_id", "prototype", "parts", "visibility", "n_frames", "starved"])

    return frames.groupBy("clip", "tracklet_id").applyInPandas(grow, schema)


def part_similarity(candidates: DataFrame, prototypes: DataFrame, least_visibility: float = 0.3) -> DataFrame:
    """For candidate pairs (clip, a, b): over all prototype pairs the best visibility-weighted mean cosine of the parts that both show; no row where they share none."""
    side = lambda p: prototypes.select("clip", F.col("tracklet_id").alias(p), F.col("prototype").alias(f"{p}_prototype"), F.posexplode(F.arrays_zip("parts", "visibility")).alias("part", p + "v")).select("clip", p, f"{p}_prototype", "part", F.col(f"{p}v.parts").alias(f"{p}_vector"), F.col(f"{p}v.visibility").alias(f"{p}_seen"))
    rows = candidates.select("clip", "a", "b").join(side("a"), ["clip", "a"]).join(side("b"), ["clip", "b", "part"])
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    a, b = F.col("a_vector"), F.col("b_vector")
    rows = rows.withColumn("size", F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))).where((F.col("a_seen") >= least_visibility) & (F.col("b_seen") >= least_visibility) & (F.col("size") > 0))
    rows = rows.withColumns({"cosine": dot(a, b) / F.col("size"), "weight": F.least("a_seen", "b_seen")})
    each = rows.groupBy("clip", "a", "b", "a_prototype", "b_prototype").agg((F.sum(F.col("weight") * F.col("cosine")) / F.sum("weight")).alias("score"), F.count("*").alias("n_parts"))
    best = each.groupBy("clip", "a", "b").agg(F.max(F.struct("score", (-F.col("a_prototype")).alias("i"), (-F.col("b_prototype")).alias("j"), "n_parts")).alias("x"))
    return best.select("clip", "a", "b", F.col("x.score").alias("score"), (-F.col("x.i")).alias("a_prototype"), (-F.col("x.j")).alias("b_prototype"), F.col("x.n_parts").alias("n_parts"))


def reranked(scored: DataFrame, k1: int = 10, k2: int = 3, keep: float = 0.3) -> DataFrame:
    """k-reciprocal re-ranking per clip: the score mixed with the Jaccard likeness of the pairs' reciprocal neighbours. scored: clip, a, b, score; missing pairs stay missing."""

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(group[["a", "b"]].to_numpy())
        n = len(ids)
        i, j = np.searchsorted(ids, group["a"]), np.searchsorted(ids, group["b"])
        score = np.full((n, n), -1.0)
        score[i, j] = score[j, i] = group["score"]
        away = 1 - score
        np.fill_diagonal(away, 0.0)
        if n <= 2 or keep >= 1:
            return group[["clip", "a", "b", "score"]]
        order = np.argsort(away, axis=1, kind="stable")

        def mutual(x: int, k: int) -> np.ndarray:
            near = order[x, : k + 1]
            return near[(order[near, : k + 1] == x).any(axis=1)]

        k = min(k1, n - 1)
        v = np.zeros((n, n))
        for x in range(n):
            own = mutual(x, k)
            wide = set(own.tolist())
            for y in own:
                other = mutual(int(y), max(1, round(k / 2)))
                if len(np.intersect1d(own, other)) > 2 / 3 * len(other):
                    wide.update(other.tolist())
            index = np.array(sorted(wide))
            w = np.exp(-away[x, index])
            v[x, index] = w / w.sum()
        if k2 > 1:
            v = np.stack([v[order[x, : min(k2, n)]].mean(axis=0) for x in range(n)])
        low = np.array([np.minimum(v[x], v).sum(axis=1) for x in range(n)])
        high = np.array([np.maximum(v[x], v).sum(axis=1) for x in range(n)])
        jaccard = 1 - np.divide(low, high, out=np.zeros((n, n)), where=high > 0)
        new = 1 - (keep * away + (1 - keep) * jaccard)
        new = (new + new.T) / 2
        return group[["clip", "a", "b"]].assign(score=new[i, j])

    return scored.select("clip", "a", "b", "score").groupBy("clip").applyInPandas(rerank, "clip long, a long, b long, score double")


def pair_features(scored: DataFrame, fps: float = 25.0) -> DataFrame:
    """One row of features per admissible pair: score, margin where they are each other's best (else -1), gap, shorter length, fewer candidates. scored: as from scored_pairs()."""
    order = Window.partitionBy("clip", "item").orderBy(F.col("score").desc(), "partner")
    ranked = both_ways(scored).withColumns({"rank": F.row_number().over(order), "second": F.lead("score").over(order), "pool": F.count("*").over(Window.partitionBy("clip", "item"))})
    ranked = ranked.withColumn("margin", F.when(F.col("rank") == 1, F.col("score") - F.coalesce("second", F.lit(0.0))).otherwise(-1.0))
    x = ranked.select("clip", F.col("item").alias("a"), F.col("partner").alias("b"), F.col("margin").alias("ma"), F.col("pool").alias("pa"))
    y = ranked.select("clip", F.col("item").alias("b"), F.col("partner").alias("a"), F.col("margin").alias("mb"), F.col("pool").alias("pb"))
    rows = scored.join(x, ["clip", "a", "b"]).join(y, ["clip", "a", "b"])
    mutual = (F.col("ma") >= 0) & (F.col("mb") >= 0)
    length = lambda p: F.col(f"{p}_end") - F.col(f"{p}_start") + 1
    return rows.select(
        "clip", "a", "b", "score", F.when(mutual, F.least("ma", "mb")).otherwise(-1.0).alias("margin"), mutual.cast("double").alias("mutual"), (F.greatest(F.lit(0), F.col("b_start") - F.col("a_end")) / fps).alias("gap_s"),
        F.least(length("a"), length("b")).alias("n_frames"), F.least("pa", "pb").alias("n_candidates"),
    )


def fusion_weights(rows: DataFrame, channels: list[str], l2: float = 1e-3, rounds: int = 25) -> dict[str, float]:
    """Weights of a conditional logit: in each episode with a right answer, the right candidates against all. rows: episode, correct, channels.

    Each round is one aggregation per episode and one over them: Fisher scoring on as many sums as channels squared. 1 for all without usable episodes.
    """
    usable = rows.groupBy("episode").agg(F.bool_or("correct").alias("any"), F.count("*").alias("n")).where("any and n > 1").select("episode")
    rows = rows.join(usable, "episode")
    spread = rows.agg(F.count("*"), *(F.stddev_pop(c) for c in channels)).first()
    if not spread[0]:
        return dict.fromkeys(channels, 1.0)
    scale = np.maximum(np.array([float(v or 0) for v in spread[1:]]), 1e-9)
    w, d = np.ones(len(channels)), len(channels)
    x = [F.coalesce(F.col(c), F.lit(0.0)) / float(s) for c, s in zip(channels, scale, strict=True)]
    for _ in range(rounds):
        total = sum((v * float(k) for v, k in zip(x, w, strict=True)), F.lit(0.0))
        e = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total)))
        right = F.when(F.col("correct"), e).otherwise(0.0)
        sums = [F.sum(e).alias("z"), F.sum(right).alias("r")] + [F.sum(e * v).alias(f"e{i}") for i, v in enumerate(x)] + [F.sum(right * v).alias(f"r{i}") for i, v in enumerate(x)] + [F.sum(e * x[i] * x[j]).alias(f"e{i}_{j}") for i in range(d) for j in range(i, d)]
        per = rows.groupBy("episode").agg(*sums)
        mean = lambda i: F.col(f"e{i}") / F.col("z")
        out = per.agg(F.count("*"), *(F.sum(F.col(f"r{i}") / F.col("r") - mean(i)) for i in range(d)), *(F.sum(F.col(f"e{i}_{j}") / F.col("z") - mean(i) * mean(j)) for i in range(d) for j in range(i, d))).first()
        n, g = out[0], np.array(out[1 : 1 + d], dtype=float)
        h, flat = np.zeros((d, d)), list(out[1 + d :])
        for i in range(d):
            for j in range(i, d):
                h[i, j] = h[j, i] = flat.pop(0)
        step = np.linalg.solve(h / n + (l2 + 1e-6) * np.eye(d), g / n - l2 * w)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    return dict(zip(channels, (w / scale).tolist(), strict=True))


def fused(llrs: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted sum of evidence; missing channels are left out."""
    weights = weights or [1.0] * len(llrs)
    return sum((F.coalesce(x, F.lit(0.0)) * w for x, w in zip(llrs, weights, strict=True)), F.lit(0.0))


def global_pairs(rows: DataFrame, distance: Column, most_distance: float, fps: float = 25.0, tolerance: int = 2, most_gap_s: float = 60.0, most_speed: float = 800.0, gap_weight: float = 0.01) -> DataFrame:
    """Pairs of one team with the first reason against them, in the order no_features, temporal_overlap, gap_too_long, speed_implausible, appearance; else their affinity (low is near).

    rows: pairs() with a_/b_ start, end, team, role, end_x, end_y, start_x, start_y. Referees are left out.
    """
    both = rows.where("coalesce(a_role, '') <> 'referee' and coalesce(b_role, '') <> 'referee' and a_team <=> b_team")
    gap = F.greatest(F.col("b_start") - F.col("a_end"), F.lit(1)) / fps
    travelled = G.distance(F.col("a_end_x"), F.col("a_end_y"), F.col("b_start_x"), F.col("b_start_y"))
    both = both.withColumns({"distance": distance, "gap_s": gap})
    reason = (
        F.when(F.col("distance").isNull(), "no_features")
        .when(F.col("b_start") - F.col("a_end") < -tolerance, "temporal_overlap")
        .when(F.col("gap_s") > most_gap_s, "gap_too_long")
        .when(travelled / F.col("gap_s") > most_speed, "speed_implausible")
        .when(F.col("distance") > most_distance, "appearance_too_far")
    )
    both = both.withColumn("reason", reason)
    return both.withColumn("affinity", F.when(F.col("reason").isNull(), F.col("distance") + gap_weight * F.col("gap_s")))


def two_pass_threads(tracklets: DataFrame, least: float = 0.0, second: float | None = 0.0, margin: float = 0.0, rounds: int = 8, most_speed: float = 15.0, slack_m: float = 3.0, fps: float = 25.0, body: tuple[float, float] = (8.0, -4.0)) -> DataFrame:
    """Threads of tracklets per clip: first each tracklet to the growing threads, batches that overlap in time by best assignment; then threads to threads, the best pair first.

    tracklets: clip, tracklet_id, start, end, team (null: unknown), anchor (null: none), embedding (null: none), entry_x, entry_y, exit_x, exit_y (unit; null: unknown).
    The score of two is body[0] * cosine + body[1]; a pair without embeddings has none and is not merged. Same anchors always merge, different ones, known different teams, members
    that share time, and moves over most_speed never do. The best must lead the next by `margin`. Returns clip, tracklet_id, thread_id.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["start", "tracklet_id"]).to_dict("records")
        none = lambda v: v is None or (isinstance(v, float) and math.isnan(v))

        def fresh(r: dict) -> dict:
            e = None if none(r["embedding"]) is True else np.asarray(r["embedding"], dtype=float)
            known = not any(none(r[c]) for c in ("entry_x", "entry_y", "exit_x", "exit_y"))
            return {
                "spans": [(r["start"], r["end"])], "ids": [r["tracklet_id"]], "team": None if none(r["team"]) else r["team"], "anchors": set() if none(r["anchor"]) else {r["anchor"]}, "sum": e, "first": r["start"], "last": r["end"],
                "entry": (r["entry_x"], r["entry_y"]) if known else None, "exit": (r["exit_x"], r["exit_y"]) if known else None,
            }

        def allowed(a: dict, b: dict) -> bool:
            if a["team"] is not None and b["team"] is not None and a["team"] != b["team"]:
                return False
            if a["anchors"] and b["anchors"] and not a["anchors"] & b["anchors"]:
                return False
            if any(s1 <= e2 and s2 <= e1 for s1, e1 in a["spans"] for s2, e2 in b["spans"]):
                return False
            early, late = (a, b) if a["last"] < b["first"] else (b, a)
            gap = (late["first"] - early["last"]) / fps
            if gap > 0 and early["exit"] and late["entry"]:
                metres = math.hypot((late["entry"][0] - early["exit"][0]) * 105, (late["entry"][1] - early["exit"][1]) * 68)
                return metres <= most_speed * gap + slack_m
            return True

        def score(a: dict, b: dict) -> float | None:
            if a["anchors"] & b["anchors"]:
                return math.inf
            if a["sum"] is None or b["sum"] is None:
                return None
            size = np.linalg.norm(a["sum"]) * np.linalg.norm(b["sum"])
            return body[0] * float(a["sum"] @ b["sum"]) / size + body[1] if size > 0 else None

        def merge(a: dict, b: dict) -> dict:
            late, early = (b, a) if b["last"] > a["last"] else (a, b), (b, a) if b["first"] < a["first"] else (a, b)
            total = a["sum"] if b["sum"] is None else b["sum"] if a["sum"] is None else a["sum"] + b["sum"]
            return {"spans": a["spans"] + b["spans"], "ids": a["ids"] + b["ids"], "team": a["team"] if a["team"] is not None else b["team"], "anchors": a["anchors"] | b["anchors"], "sum": total, "first": min(a["first"], b["first"]), "last": max(a["last"], b["last"]), "entry": early[0]["entry"], "exit": late[0]["exit"]}

        threads: list[dict] = []
        batch: list[dict] = []
        batches, closing = [], None
        for r in rows:
            if batch and r["start"] <= closing:
                batch.append(r)
                closing = min(closing, r["end"])
            else:
                batch, closing = [r], r["end"]
                batches.append(batch)
        for batch in batches:
            new = [fresh(r) for r in batch]
            n, m = len(new), len(threads)
            table = np.full((n, m + n), -1e12)
            for i, x in enumerate(new):
                for k, t in enumerate(threads):
                    s = score(t, x) if allowed(t, x) else None
                    if s is not None:
                        table[i, k] = min(s, 1e9)
                table[i, m + i] = least - 1e-9
            r, c = hungarian(-table)
            for i, k in zip(r.tolist(), c.tolist(), strict=True):
                others = np.delete(table[i, :m], k) if k < m else np.empty(0)
                runner = others.max() if len(others) else -math.inf
                if k < m and table[i, k] >= least and table[i, k] - runner >= margin:
                    threads[k] = merge(threads[k], new[i])
                else:
                    threads.append(new[i])
        for _ in range(rounds if second is not None else 0):
            options = [(s, i, j) for i in range(len(threads)) for j in range(i + 1, len(threads)) if allowed(threads[i], threads[j]) and (s := score(threads[i], threads[j])) is not None and s >= second]
            if not options:
                break
            used, joined = set(), []
            for _s, i, j in sorted(options, key=lambda o: (-o[0], o[1], o[2])):
                if i not in used and j not in used:
                    used |= {i, j}
                    joined.append(merge(threads[i], threads[j]))
            threads = [t for k, t in enumerate(threads) if k not in used] + joined
        out = [(group["clip"].iloc[0], t, min(x["ids"])) for x in threads for t in x["ids"]]
        return pd.DataFrame(out, columns=["clip", "tracklet_id", "thread_id"])

    return tracklets.groupBy("clip").applyInPandas(build, "clip long, tracklet_id long, thread_id long")


def oracle_anchors(tracklets: DataFrame, coverage: float = 0.5, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Anchors for a share of the tracklets whose name is known, in hashed order per clip; a share `noise` gets a wrong name. tracklets: clip, tracklet_id, name (null: none).

    log_lr is log((1 - e) / e) with the noise kept between 0.001 and 0.999.
    """
    known = tracklets.where("name is not null")
    order = Window.partitionBy("clip").orderBy(F.xxhash64(F.lit(seed), "clip", "tracklet_id"), "tracklet_id")
    rows = known.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("clip")), "names": F.array_sort(F.collect_set("name").over(Window.partitionBy("clip")))})
    rows = rows.where(F.col("place") <= F.round(F.col("n") * coverage))
    u = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "clip", "tracklet_id"), 11) * F.lit(2.0**-53)
    others = F.array_remove("names", F.col("name"))
    wrong = F.get(others, F.floor(u("which") * F.size(others)).cast("int"))
    e = min(0.999, max(0.001, noise))
    return rows.select("clip", "tracklet_id", F.when((u("flip") < noise) & (F.size(others) > 0), wrong).otherwise(F.col("name")).alias("candidate"), F.lit(math.log((1 - e) / e)).alias("log_lr"))


def frontier(candidates: DataFrame) -> DataFrame:
    """Coverage and precision at every score of an episode's best candidate, from the surest down. candidates: episode, score, correct."""
    best = candidates.groupBy("episode").agg(F.max(F.struct("score", F.col("correct").cast("int").alias("hit"))).alias("x"), F.max(F.col("correct").cast("int")).alias("answer"))
    need = best.agg(F.sum("answer")).first()[0] or 0
    at = best.groupBy(F.col("x.score").alias("threshold")).agg(F.sum("x.hit").alias("hits"), F.count("*").alias("n"))
    bands = at.withColumn("band", F.floor(F.col("threshold") * 64))  # runs in two steps: within bands of scores, then over the bands
    own = Window.partitionBy("band").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = bands.groupBy("band").agg(F.sum("hits").alias("h"), F.sum("n").alias("m"))
    before = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("band", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"))  # a row a band: scores are bounded
    rows = bands.join(totals, "band").select("threshold", (F.col("h") + F.sum("hits").over(own)).alias("correct"), (F.col("m") + F.sum("n").over(own)).alias("admitted"))
    return rows.select("threshold", "correct", (F.col("admitted") - F.col("correct")).alias("wrong"), F.round(F.col("correct") / max(need, 1), 6).alias("coverage"), F.round(F.col("correct") / F.col("admitted"), 6).alias("precision"))


def hull(curve: DataFrame) -> DataFrame:
    """The points of a frontier that no point of at least their coverage beats in precision."""
    best = curve.where("coverage > 0").groupBy("coverage").agg(F.max(F.struct("precision", F.col("threshold"))).alias("x"))
    beyond = F.max("x.precision").over(Window.orderBy(F.col("coverage").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("beyond", beyond).where("beyond is null or x.precision > beyond").select("coverage", F.col("x.precision").alias("precision"), F.col("x.threshold").alias("threshold"))


def zero_wrong(counts: DataFrame) -> DataFrame:
    """Of the thresholds without a wrong merge the one with most right ones (the lowest of equals); none: 0 and null. counts: threshold, correct, wrong."""
    best = counts.where("wrong = 0 and correct > 0").agg(F.max(F.struct("correct", (-F.col("threshold")).alias("t"))).alias("x"))
    return best.select(F.coalesce("x.correct", F.lit(0)).alias("correct"), (-F.col("x.t")).alias("threshold"))


def bootstrap_delta(rows: DataFrame, draws: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Difference of two methods' accuracies with an interval from clusters drawn anew. rows: cluster, hit_a, hit_b (one a query).

    A cluster comes into a draw as often as a hashed Poisson number of mean 1 says, so draws need no list of clusters.
    """
    per = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("hit_b").cast("int") - F.col("hit_a").cast("int")).alias("d"))
    each = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "draw", "cluster"), 11) * F.lit(2.0**-53)
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    times = F.when(F.col("draw") == 0, 1).otherwise(F.size(F.filter(F.array(*map(F.lit, steps)), lambda c: c <= u)))
    each = each.withColumn("k", times).groupBy("draw").agg((F.sum(F.col("d") * F.col("k")) / F.nullif(F.sum(F.col("n") * F.col("k")), F.lit(0))).alias("delta"), F.count("*").alias("n_clusters"))
    low, high = (F.percentile(F.when(F.col("draw") > 0, F.col("delta")), F.lit(q)) for q in (alpha / 2, 1 - alpha / 2))
    return each.agg(F.round(F.max(F.when(F.col("draw") == 0, F.col("delta"))), 6).alias("delta"), F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"), F.max("n_clusters").alias("n_clusters"))


def merge_quality(threads: DataFrame, composition: DataFrame, least_frames: int = 3, least_share: float = 0.2) -> DataFrame:
    """Per clip: pairs of tracklets in one thread and how many are one subject; pairs of a subject that were not merged; precision and recall.

    threads: clip, tracklet_id, thread_id; composition: clip, tracklet_id, gt_id, n. A tracklet's subject is its majority (of equal ones the lowest id); it stands for every subject with enough frames and share.
    """
    top = composition.groupBy("clip", "tracklet_id").agg(F.max(F.struct("n", (-F.col("gt_id")).alias("g"))).alias("x"), F.sum("n").alias("total"))
    rows = threads.join(top.select("clip", "tracklet_id", (-F.col("x.g")).alias("gt_id")), ["clip", "tracklet_id"], "left")
    side = lambda p: rows.select("clip", "thread_id", F.col("tracklet_id").alias(p), F.col("gt_id").alias(f"g{p}"))
    merged = side("a").join(side("b"), ["clip", "thread_id"]).where("a < b")
    right = F.coalesce(F.col("ga") == F.col("gb"), F.lit(False))
    made = merged.groupBy("clip").agg(F.count("*").alias("n_pairs"), F.count(F.when(right, 1)).alias("n_pairs_correct"), F.count(F.when(F.col("ga").isNull() | F.col("gb").isNull(), 1)).alias("n_pairs_unmatched"))
    owners = composition.join(top.select("clip", "tracklet_id", "total"), ["clip", "tracklet_id"]).where((F.col("n") >= least_frames) & (F.col("n") / F.col("total") >= least_share)).select("clip", "tracklet_id", "gt_id")
    owners = owners.join(threads, ["clip", "tracklet_id"], "left")
    one = lambda p: owners.select("clip", "gt_id", F.col("tracklet_id").alias(p), F.col("thread_id").alias(f"t{p}"))
    missed = one("a").join(one("b"), ["clip", "gt_id"]).where("a < b and not coalesce(ta = tb, false)").groupBy("clip").agg(F.count("*").alias("n_missed_pairs"))
    out = threads.select("clip").distinct().join(made, "clip", "left").join(missed, "clip", "left").fillna(0, ["n_pairs", "n_pairs_correct", "n_pairs_unmatched", "n_missed_pairs"])
    found = F.col("n_pairs_correct")
    return out.withColumns({"merge_precision": F.round(found / F.nullif(F.col("n_pairs"), F.lit(0)), 4), "merge_recall": F.round(found / F.nullif(found + F.col("n_missed_pairs"), F.lit(0)), 4)})


def anchored_subjects(dets: DataFrame, truth: DataFrame, threshold: float = 0.5, least: int = 1) -> DataFrame:
    """Each tracklet's subject by frames with enough overlap, every such box voting (not only a frame's best); of equal counts the first."""
    votes = E.overlaps(dets, truth, threshold).groupBy("clip", "tracklet_id", "gt_id").agg(F.countDistinct("frame").alias("n")).where(F.col("n") >= least)
    top = votes.groupBy("clip", "tracklet_id").agg(F.max(F.struct("n", (-F.col("gt_id")).alias("g"))).alias("x"))
    return top.select("clip", "tracklet_id", (-F.col("x.g")).alias("gt_id"), F.col("x.n").alias("n_frames"))


def joined_features(boxes: DataFrame, dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The one detection of most overlap for each tracklet box, then the one best box for each detection; losers get no second choice.

    boxes: clip, frame, tracklet_id, x, y, w, h; dets: clip, frame, det_id, x, y, w, h.
    """
    d = dets.select("clip", "frame", "det_id", *(F.col(c).alias(f"d{c}") for c in "xywh"))
    rows = boxes.join(d, ["clip", "frame"]).withColumn("iou", G.iou([F.col(c) for c in "xywh"], [F.col(f"d{c}") for c in "xywh"])).where(F.col("iou") >= threshold)
    mine = Window.partitionBy("clip", "frame", "tracklet_id").orderBy(F.col("iou").desc(), "det_id")
    theirs = Window.partitionBy("clip", "frame", "det_id").orderBy(F.col("iou").desc(), F.col("tracklet_id").desc())
    rows = rows.withColumn("r", F.row_number().over(mine)).where("r = 1").withColumn("s", F.row_number().over(theirs)).where("s = 1")
    return rows.select("clip", "frame", "tracklet_id", "det_id", "iou")


def frame_exits(switches: DataFrame, boxes: DataFrame, width: float, height: float, fps: float = 25.0, border: float = 0.04, least_s: float = 0.2, long_s: float = 2.0) -> DataFrame:
    """Whether each switch (clip, gt_id, from_frame, to_frame) is an exit: the subject's largest absence between the two begins and ends at the border (a long one: begins or ends)."""
    order = Window.partitionBy("clip", "gt_id").orderBy("frame")
    near = (F.col("x") <= border * width) | (F.col("y") <= border * height) | (F.col("x") + F.col("w") >= (1 - border) * width) | (F.col("y") + F.col("h") >= (1 - border) * height)
    steps = boxes.withColumn("near", near).withColumns({"next_frame": F.lead("frame").over(order), "next_near": F.lead("near").over(order)}).where("next_frame is not null")
    rows = switches.join(steps.select("clip", "gt_id", "frame", "next_frame", "near", "next_near"), ["clip", "gt_id"], "left").where("frame is null or (frame >= from_frame and next_frame <= to_frame)")
    most = rows.groupBy("clip", "gt_id", "from_frame", "to_frame").agg(F.max(F.struct((F.col("next_frame") - F.col("frame")).alias("gap"), (-F.col("frame")).alias("f"), "near", "next_near")).alias("x"))
    seconds = F.col("x.gap") / fps
    exit_ = F.when(seconds < least_s, False).when(seconds >= long_s, F.col("x.near") | F.col("x.next_near")).otherwise(F.col("x.near") & F.col("x.next_near"))
    return switches.join(most, ["clip", "gt_id", "from_frame", "to_frame"], "left").select("clip", "gt_id", "from_frame", "to_frame", F.coalesce(exit_, F.lit(False)).alias("is_exit"), seconds.alias("absence_s"))


def gap_anchors(frames: DataFrame, stride: int = 5) -> DataFrame:
    """Every stride-th frame of a blackout with the last good frame before and the first after. frames: clip, frame, good."""
    order = Window.partitionBy("clip").orderBy("frame")
    good = F.when(F.col("good"), F.col("frame"))
    rows = frames.withColumns({"left": F.last(good, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "right": F.last(good, ignorenulls=True).over(Window.partitionBy("clip").orderBy(F.col("frame").desc()).rowsBetween(Window.unboundedPreceding, -1)), "block": F.sum(F.col("good").cast("int")).over(order)})
    rows = rows.where(~F.col("good")).withColumn("i", F.row_number().over(Window.partitionBy("clip", "block").orderBy("frame")) - 1).where(F.col("i") % stride == 0)
    return rows.select("clip", "frame", F.explode(F.array_compact(F.array("left", "right"))).alias("anchor"))


def cosine_clusters(embeddings: DataFrame, threshold: float) -> DataFrame:
    """Greedy clusters per clip: an entity joins the first cluster whose mean is near enough, in order of id. embeddings: clip, entity, embedding."""

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("entity", ignore_index=True)
        sums, label = [], []
        for e in group["embedding"]:
            x = np.asarray(e, dtype=float)
            x = x / (np.linalg.norm(x) or 1)
            near = [float(s @ x) / (np.linalg.norm(s) or 1) for s in sums]
            k = next((i for i, v in enumerate(near) if v >= threshold), len(sums))
            if k == len(sums):
                sums.append(x)
            else:
                sums[k] = sums[k] + x
            label.append(k)
        return pd.DataFrame({"clip": group["clip"], "entity": group["entity"], "cluster": label})

    return embeddings.groupBy("clip").applyInPandas(cluster, "clip long, entity long, cluster long")


def serving_diagnostics(values: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Per channel the median, least and most of its raw values and whether over half fall outside the range it was fitted on. values: channel, value."""
    ranges = values.sparkSession.createDataFrame([(k, *v) for k, v in fitted.items()], "channel string, low double, high double")
    rows = values.join(F.broadcast(ranges), "channel")  # a few channels
    outside = F.avg((~F.col("value").between(F.col("low"), F.col("high"))).cast("int"))
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(outside, 4).alias("outside"), (outside > 0.5).alias("flagged"))


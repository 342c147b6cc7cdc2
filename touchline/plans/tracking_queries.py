"""Queries over frames, boxes, possession timelines, spotted actions and tracklet pairs, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import evaluation as E
from touchline.operators import pairs as P
from touchline.operators import runs as R
from touchline.sources import tracking as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_ROWS = """
ev as (select event_id as e, event_id // 400 as clip, event_id % 400 as pos from events),
truth as (select clip, pos // 4 as frame, e % 4 as gt_id, cast((e % 4) * 40 + pos // 4 * 2 as double) as x, cast(100 + (e % 4) * 3 as double) as y, 60.0::double as w, cast(60 + (e % 4) * 30 as double) as h from ev where e % 23 <> 0),
dets as (select clip, pos // 4 as frame, e as det_id, (case when (pos // 4 // 10) % 5 = 4 then (e % 4 + 1) % 4 else e % 4 end) * 10 + pos // 4 // 25 as tracklet_id,
  cast((e % 4) * 40 + pos // 4 * 2 + e * 7 % 13 - 6 as double) as x, cast(100 + (e % 4) * 3 + e * 11 % 9 - 4 as double) as y, 60.0::double as w, cast(60 + (e % 4) * 30 + e * 5 % 7 - 3 as double) as h, (e * 37 % 1000) / 1000 as confidence from ev where e % 11 <> 0),
poss as (select clip, pos as frame, case when e % 17 <> 0 then e // 6 * 7 % 5 end as possessor, case when e % 17 <> 0 then e // 6 * 7 % 5 end % 2 as team, (e * 13 % 100) / 100 as confidence from ev where e % 37 <> 0),
ball as (select clip, pos as frame, cast(case when pos // 20 % 2 = 0 then pos * 6 % 240 else 240 - pos * 6 % 240 end + e * 7 % 5 as double) as x, cast(140 + e * 3 % 17 + pos % 40 as double) as y, (e * 29 % 100) / 100 as confidence from ev where e % 19 > 2 and e % 100 < 80)
"""
_SEGMENTS = """, p0 as (select *, frame - lag(frame) over w as step, lag(possessor) over w as before from poss where possessor is not null window w as (partition by clip order by frame)),
p1 as (select *, sum((step is null or step > 1 or before <> possessor)::int) over (partition by clip order by frame) as run from p0),
p2 as (select clip, run, any_value(possessor) as possessor, arg_min(team, frame) as team, min(frame) as s, max(frame) as f, count(*) as n, sum(confidence) as total from p1 group by clip, run having count(*) >= 3),
p3 as (select *, lag(possessor) over (partition by clip order by run) as before from p2),
p4 as (select *, sum((before is null or before <> possessor)::int) over (partition by clip order by run)::bigint as segment from p3),
seg as (select clip, segment, any_value(possessor) as possessor, arg_min(team, s) as team, min(s) as s, max(f) as f, sum(n)::bigint as n_frames, sum(total) / sum(n) as confidence from p4 group by clip, segment)
"""
_IOU = "(greatest(0, least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x)) * greatest(0, least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y)))"
_BEST = f""", ov as (select d.*, g.gt_id, g.h as gh, {_IOU} / (d.w * d.h + g.w * g.h - {_IOU}) as iou from dets d join truth g on d.clip = g.clip and d.frame = g.frame),
best as (select * from ov where iou >= 0.5 qualify row_number() over (partition by clip, frame, det_id order by iou desc, gt_id) = 1),
votes as (select clip, tracklet_id, gt_id, count(*) as n from best group by all),
top as (select clip, tracklet_id, sum(n)::bigint as m, max(n) as t, arg_min(gt_id, (-n, gt_id)) as majority_gt from votes group by all)
"""


def query(name: str, sql: str | None = None, base: str = _ROWS):  # noqa: ANN201
    def register(function):  # noqa: ANN001, ANN202
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = f"with {base} {sql}"
        return function

    return register


@query("possession_segments", 'select clip, segment, possessor, team, s as start, f as "end", n_frames, round(confidence, 4) as confidence from seg', _ROWS + _SEGMENTS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.possession_segments(S.possessors(spark, sf)).withColumn("confidence", F.round("confidence", 4))


@query(
    "possession_transitions",
    """select clip, possessor as player_id, team, round(confidence, 4) as confidence, confidence < 0.45 as contested, 'pass' as type, f as frame, nxt as receiver from (select *, lead(possessor) over (partition by clip order by segment) as nxt from seg) where nxt is not null
  union all select clip, possessor, team, round(confidence, 4), confidence < 0.45, 'reception', s, cast(null as bigint) from (select *, lead(possessor) over (partition by clip order by segment) as nxt from seg) where nxt is null or n_frames >= 7""",
    _ROWS + _SEGMENTS,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.transition_events(S.possessors(spark, sf))


@query("possession_smoothed", ", near as (select clip, frame, coalesce(possessor, -1) as own, list(coalesce(possessor, -1)) over (partition by clip order by frame rows between 2 preceding and 2 following) as near from poss), votes as (select *, list_transform(near, lambda x: len(list_filter(near, lambda y: y = x))) as n from near) select clip, frame, nullif(case when len(list_filter(near, lambda y: y = own)) = list_max(n) then own else near[list_position(n, list_max(n))] end, -1) as possessor from votes", _ROWS.rstrip())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.smoothed(S.possessors(spark, sf))


@query("possession_profile", "select b.*, s.n_segments, s.mean_segment, round(n_held / n_frames, 4) as coverage from (select clip, count(*) as n_frames, count(possessor) as n_held, count(*) filter (possessor is not null and confidence < 0.45) as n_low_confidence from poss group by clip) b left join (select clip, count(*) as n_segments, round(avg(n), 4) as mean_segment from (select clip, run, count(*) as n from p1 group by all) group by clip) s using (clip)", _ROWS + _SEGMENTS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.coverage_profile(S.possessors(spark, sf))


@query("possession_profile_pooled", "select count(*) as n_frames, count(possessor) as n_held, count(*) filter (possessor is not null and confidence < 0.45) as n_low_confidence, round(count(possessor) / count(*), 4) as coverage from poss")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.pooled_profile(R.coverage_profile(S.possessors(spark, sf)))


_FRAGMENTS = """, f0 as (select *, frame - lag(frame) over (partition by clip, gt_id order by frame) as step from truth), f1 as (select *, sum((step is null or step > 1)::int) over (partition by clip, gt_id order by frame) as run from f0),
f2 as (select clip, gt_id, run, min(frame) as start, max(frame) as stop, count(*) as n_frames from f1 group by all having count(*) >= 2)"""


@query("track_fragments", 'select clip, gt_id, start, stop as "end", n_frames, cast(row_number() over (partition by clip order by gt_id, run) as int) as fragment_id from f2', _ROWS + _FRAGMENTS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.fragments(S.true_boxes(spark, sf), "gt_id", 1, 2)


@query("observable_spans", 'select clip, gt_id, min(frame) as start, max(frame) as "end" from (select *, sum((step is null or step > 3)::int) over (partition by clip, gt_id order by frame) as run from f0) group by clip, gt_id, run', _ROWS + _FRAGMENTS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.observable_spans(S.true_boxes(spark, sf), "gt_id")


@query(
    "ball_interpolation",
    """select clip, frame + k as frame, round(case when k = 0 then x else x + k / gap * (nx - x) end, 4) as x, round(case when k = 0 then y else y + k / gap * (ny - y) end, 4) as y, round(case when k = 0 then confidence else least(confidence, nc) * 0.5 end, 4) as confidence, k > 0 as interpolated
  from (select *, lead(frame) over w - frame as gap, lead(x) over w as nx, lead(y) over w as ny, lead(confidence) over w as nc from ball window w as (partition by clip order by frame)), range(0, 30) r(k) where k = 0 or (gap > 1 and gap <= 30 and k < gap)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.interpolated_ball(S.ball(spark, sf))
    return rows.select("clip", "frame", *(F.round(c, 4).alias(c) for c in ("x", "y", "confidence")), "interpolated")


@query(
    "timeline_buckets",
    """, fr as (select clip, frame, avg(confidence) as c from dets group by all), seen as (select clip, frame // 25 as bucket, avg(c) as c from fr group by all), tr as (select clip, tracklet_id, min(frame) // 25 as b, max(frame) // 25 as d from dets group by all),
  spine as (select clip, unnest(range(0, max(frame // 25) + 1)) as bucket from fr group by clip), act as (select s.clip, s.bucket, count(t.tracklet_id) as n, count(*) filter (t.b = s.bucket) as births, count(*) filter (t.d = s.bucket) as deaths from spine s left join tr t on t.clip = s.clip and s.bucket between t.b and t.d group by all),
  o as (select a.clip, a.bucket, round(coalesce(c, 0), 4) as detection_confidence, n as n_active, round(case when n > 0 then greatest(0, 1 - (births + deaths) / n) else 0 end, 4) as tracking_stability, c is not null as seen from act a left join seen using (clip, bucket))
  select clip, bucket, detection_confidence, n_active, tracking_stability, concat_ws(',', case when seen and detection_confidence < 0.4 then 'weak_detection' end, case when n_active > 0 and tracking_stability < 0.5 then 'track_churn' end) as flags from o""",
    _ROWS.rstrip(),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.timeline_buckets(S.detections(spark, sf))


def _ball(spark: SparkSession, sf: str) -> DataFrame:
    return R.interpolated_ball(S.ball(spark, sf))


@query("possessor_candidates", "select b.clip, b.frame, d.tracklet_id, round(sqrt(greatest(d.x - b.x, 0, b.x - d.x - d.w) * greatest(d.x - b.x, 0, b.x - d.x - d.w) + greatest(d.y - b.y, 0, b.y - d.y - d.h) * greatest(d.y - b.y, 0, b.y - d.y - d.h)), 4) as distance from ball b join dets d on d.clip = b.clip and d.frame = b.frame")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.possessor_candidates(S.ball(spark, sf), S.detections(spark, sf)).select("clip", "frame", "tracklet_id", F.round("distance", 4).alias("distance"))


@query("nearest_possessor")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.nearest_possessor(_ball(spark, sf), S.detections(spark, sf))


@query("viterbi_possession")
def _(spark: SparkSession, sf: str) -> DataFrame:
    boxes = S.detections(spark, sf)
    teams = boxes.select("clip", "tracklet_id", (F.floor(F.col("tracklet_id") / 10) % 2).alias("team")).distinct()
    return R.viterbi_possession(_ball(spark, sf), boxes, teams)


@query("camera_shift")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.camera_shift(S.detections(spark, sf))


@query("ball_touches")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.ball_touches(_ball(spark, sf))


@query("resolved_ball")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolved_ball(S.detections(spark, sf)).select("clip", "frame", "det_id")


@query("suppressed_actions")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.suppress(S.spotted_actions(spark, sf), ["clip", "slot", "class_id"], 25)




def _matches(spark: SparkSession, sf: str) -> DataFrame:
    found = E.best_boxes(S.detections(spark, sf), S.true_boxes(spark, sf)).groupBy("clip", "gt_id", "frame").agg(F.min("tracklet_id").alias("hyp_id"))
    return found


_MATCHES = ", mt as (select clip, gt_id, frame, min(tracklet_id) as hyp_id from best group by all)"


@query(
    "persistent_switches",
    """, r0 as (select *, lag(hyp_id) over (partition by clip, gt_id order by frame) as b from mt), r1 as (select *, sum((b is null or b <> hyp_id)::int) over (partition by clip, gt_id order by frame) as run from r0),
  r2 as (select clip, gt_id, run, any_value(hyp_id) as hyp_id, count(*) as n from r1 group by all), r3 as (select r2.*, t.s, lag(hyp_id) over (partition by clip, gt_id, t.s order by run) as b from r2, (values (0.2::double), (0.5::double), (1.0::double)) t(s) where n / 25 >= t.s)
  select s as threshold_s, coalesce(count(*) filter (b <> hyp_id), 0) as n_switches from r3 group by s""",
    (_ROWS + _BEST + _MATCHES).rstrip(),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.persistent_switches(_matches(spark, sf), thresholds=(0.2, 0.5, 1.0))


@query("switch_instances", "select clip, gt_id, frame, b as from_id, hyp_id as to_id from (select *, lag(hyp_id) over (partition by clip, gt_id order by frame) as b from mt) where b <> hyp_id", _ROWS + _BEST + _MATCHES)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.switch_instances(_matches(spark, sf))


@query("switch_diff")
def _(spark: SparkSession, sf: str) -> DataFrame:
    matches = _matches(spark, sf)
    other = matches.withColumn("hyp_id", F.when(F.col("frame") % 50 < 25, F.col("hyp_id")).otherwise(F.col("gt_id")))
    return E.switch_diff(E.switch_instances(matches), E.switch_instances(other), 5)


@query("iou_pairs", "select clip, frame, det_id, gt_id, round(iou, 5) as iou from ov where iou >= 0.5", _ROWS + _BEST)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.overlaps(S.detections(spark, sf), S.true_boxes(spark, sf)).select("clip", "frame", "det_id", "gt_id", F.round("iou", 5).alias("iou"))


@query("best_boxes", "select clip, frame, det_id, gt_id from best", _ROWS + _BEST)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_boxes(S.detections(spark, sf), S.true_boxes(spark, sf)).select("clip", "frame", "det_id", "gt_id")


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return E.match_frames(S.detections(spark, sf), S.true_boxes(spark, sf))


@query("detection_matches")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf)


@query("detection_report")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.detection_report(_matched(spark, sf), S.true_boxes(spark, sf))


@query("detection_height_bins")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.height_bins(_matched(spark, sf), S.true_boxes(spark, sf), (60.0, 100.0, 140.0))


@query("miss_bursts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.miss_bursts(_matched(spark, sf), S.true_boxes(spark, sf))


@query("detection_jitter")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.jitter(_matched(spark, sf), S.detections(spark, sf), S.true_boxes(spark, sf))


@query("gt_composition", "select * from votes", _ROWS + _BEST)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.composition(S.detections(spark, sf), S.true_boxes(spark, sf))


_PURITY = ", pu as (select l.clip, l.tracklet_id, l.n as length, coalesce(m, 0) as matched_frames, majority_gt, round(t / m, 4) as purity, coalesce(m - t, 0) as mixed_frames, round(coalesce(m - t, 0) / 25.0, 4)::double as mixed_seconds from (select clip, tracklet_id, count(*) as n from dets group by all) l left join top using (clip, tracklet_id))"


@query("tracklet_purity", "select * from pu", _ROWS + _BEST + _PURITY)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.tracklet_purity(S.detections(spark, sf), S.true_boxes(spark, sf))


@query("purity_summary", "select clip, count(*) as n_tracklets, count(purity) as n_matched, round(sum(purity * matched_frames) / sum(matched_frames) filter (purity is not null), 4) as mean_purity, round(count(*) filter (purity < 1) / count(purity), 4) as frac_impure, round(quantile_cont(length, 0.25), 4) as length_p25, round(quantile_cont(length, 0.5), 4) as length_median, round(quantile_cont(length, 0.75), 4) as length_p75 from pu group by clip", _ROWS + _BEST + _PURITY)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.purity_summary(E.tracklet_purity(S.detections(spark, sf), S.true_boxes(spark, sf)))


@query(
    "tracklet_segments",
    """, d0 as (select *, frame - lag(frame) over (partition by clip, tracklet_id order by frame) as step from dets), d1 as (select *, sum((step is null or step > 12)::int) over (partition by clip, tracklet_id order by frame) as run from d0),
  z as (select clip, tracklet_id, run, min(frame) as start, max(frame) as stop from d1 group by all having count(*) >= 5), vo as (select d1.clip, d1.tracklet_id, d1.run, b.gt_id, count(*) as n from d1 join best b on b.det_id = d1.det_id group by all),
  tp as (select *, sum(n) over (partition by clip, tracklet_id, run)::bigint as matched, row_number() over (partition by clip, tracklet_id, run order by n desc, gt_id) as place from vo)
  select clip, tracklet_id, start, stop as "end", gt_id, tp.n as frames, matched from z join tp using (clip, tracklet_id, run) where place = 1""",
    (_ROWS + _BEST).rstrip(),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.tracklet_segments(S.detections(spark, sf), S.true_boxes(spark, sf))


@query("identity_report")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table = E.composition(S.detections(spark, sf), S.true_boxes(spark, sf))
    entity = (F.col("clip") * 100 + F.floor(F.col("tracklet_id") / 10)).alias("entity_id")
    table = table.groupBy(entity, (F.col("clip") * 10 + F.col("gt_id")).alias("gt_id")).agg(F.sum("n").alias("n"))
    labels = table.select("entity_id").distinct().withColumn("label", F.when(F.col("entity_id") % 7 != 0, F.concat(F.lit("home:"), F.col("entity_id").cast("string"))))
    return E.identity_report(table, labels)


@query("crop_yield", "select clip, tracklet_id, count(*) filter (h >= 60) as n_crops, count(*) filter (h >= 60) < 8 as starved from dets group by all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.crop_yield(S.detections(spark, sf))


@query("action_scores")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.action_report(S.spotted_actions(spark, sf), S.labelled_actions(spark, sf))


@query("action_summary")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.action_summary(E.action_report(S.spotted_actions(spark, sf), S.labelled_actions(spark, sf)))


@query("action_verdicts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.verdicts(S.spotted_actions(spark, sf), S.labelled_actions(spark, sf))


@query("action_average_map")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.average_map(S.spotted_actions(spark, sf), S.labelled_actions(spark, sf), (6, 12, 25))


@query("fused_models")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.fused_models([S.spotted_actions(spark, sf, m) for m in range(3)], solo_classes=(4,))


@query("event_corroboration")
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = R.transition_events(S.possessors(spark, sf)).withColumn("event_id", F.col("frame") * 2 + (F.col("type") == "pass").cast("int"))
    return E.event_corroboration(events, R.ball_touches(_ball(spark, sf)))


@query("hota")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.hota(S.detections(spark, sf), S.true_boxes(spark, sf))


@query("possession_localisation", """, bd as (select clip, unnest([s, f]) as b from seg), la as (select clip, e as event_id, pos * 3 as frame from ev where e % 3 = 0)
  select la.clip, event_id, frame, arg_min(b, (abs(b - frame), b)) as predicted, min(abs(b - frame)) as error_frames from la join bd on bd.clip = la.clip group by all""", (_ROWS + _SEGMENTS).rstrip())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.possession_localisation(S.possessors(spark, sf), S.labelled_actions(spark, sf).where("event_id % 3 = 0"))  # as the SQL does


_PAIRS = """ft as (select vec_id // 40 as clip, vec_id % 40 as tracklet_id, vec_id % 40 * 25 as start, vec_id % 40 * 25 + 10 + vec_id * 7 % 30 as stop, vec_id * 3 % 2 as team, label::bigint as label, embedding::double[] as v from embeddings),
pr as (select a.clip, a.tracklet_id as a, b.tracklet_id as b, a.label = b.label as same, case when b.start - a.stop < -2 then 'temporal_overlap' when a.team <> b.team then 'team_mismatch' end as reason, a.v as va, b.v as vb from ft a join ft b on a.clip = b.clip and (a.start < b.start or (a.start = b.start and a.tracklet_id < b.tracklet_id))),
sc as (select clip, a, b, same, list_cosine_similarity(va, vb) as score from pr where reason is null),
bw as (select clip, a as item, b as partner, same, score from sc union all select clip, b, a, same, score from sc),
rk as (select *, row_number() over w as rank, score - lead(score) over w as margin, sum(same::int) over w as hits from bw window w as (partition by clip, item order by score desc, partner)),
mb as (select x.clip, least(x.item, x.partner) as a, greatest(x.item, x.partner) as b, x.score, x.same from rk x join rk y on y.clip = x.clip and y.item = x.partner and y.partner = x.item and y.rank = 1 where x.rank = 1 and x.item < x.partner)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return P.scored_pairs(S.features(spark, sf))


@query("pair_gates", "select clip, a as a_tracklet_id, b as b_tracklet_id, reason from pr", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.gated(P.pairs(S.features(spark, sf).drop("embedding")), [P.overlap_reason(), P.team_reason()])
    return rows.select("clip", "a_tracklet_id", "b_tracklet_id", "reason")


@query("pair_scores", "select clip, a, b, same, round(score, 5) as score from sc", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("clip", "a", "b", (F.col("a_label") == F.col("b_label")).alias("same"), F.round("score", 5).alias("score"))


@query("mutual_best", "select clip, a, b, round(score, 5) as score, same from mb", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.mutual_best(_scored(spark, sf)).withColumn("score", F.round("score", 5))


@query("merge_counts", "select t as threshold, count(*) filter (same) as correct, count(*) filter (not same) as wrong from mb, (values (0.0::double), (0.2::double), (0.3::double), (0.4::double)) v(t) where score >= t group by t", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.merge_counts(P.mutual_best(_scored(spark, sf)), [0.0, 0.2, 0.3, 0.4])


@query("merge_curve", "select clip, a, b, round(score, 6) as score, cast(sum(same::int) over w as bigint) as correct, cast(sum((not same)::int) over w as bigint) as wrong from mb window w as (partition by clip order by score desc, a, b rows unbounded preceding)", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.merge_curve(P.mutual_best(_scored(spark, sf)))


_COUNTS = "(select t as threshold, count(*) filter (same) as correct, count(*) filter (not same) as wrong from mb, (values (0.0::double), (0.2::double), (0.3::double), (0.4::double)) v(t) where score >= t group by t)"


@query("budget_curve", f"select budget, coalesce(correct, 0) as correct, coalesce(wrong, 0) as wrong, threshold from (values (0), (10), (100), (1000)) b(budget) left join (select budget, c.*, row_number() over (partition by budget order by correct desc, wrong, threshold) as place from {_COUNTS} c, (values (0), (10), (100), (1000)) b(budget) where wrong <= budget) using (budget) where coalesce(place, 1) = 1", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.budget_curve(P.merge_counts(P.mutual_best(_scored(spark, sf)), [0.0, 0.2, 0.3, 0.4]), [0, 10, 100, 1000])


@query("error_overlap", "select count(*) as n_a, count(*) filter (clear) as n_b, count(*) filter (clear) as n_shared, round(coalesce(count(*) filter (clear) / nullif(count(*), 0), 0), 4) as jaccard, count(*) filter (not clear) as only_a, 0::bigint as only_b from (select least(coalesce(x.margin, 1e300), coalesce(y.margin, 1e300)) >= 0.02 as clear from rk x join rk y on y.clip = x.clip and y.item = x.partner and y.partner = x.item and y.rank = 1 where x.rank = 1 and x.item < x.partner and not x.same)", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    return P.error_overlap(P.mutual_best(scored), P.mutual_best(scored, 0.02))


@query("merged_threads")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.features(spark, sf)
    return P.merge_tracklets(rows, P.mutual_best(P.scored_pairs(rows)))


@query("episodes", "select a.clip, a.tracklet_id as query, count(*) as n_candidates, count(*) filter (b.label = a.label) as n_correct from ft a join ft b on a.clip = b.clip and b.start > a.stop and a.team = b.team group by all", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.episodes(S.features(spark, sf))


@query("retrieval", "select clip, item, count(*) as n_candidates, sum(same::int)::bigint as n_true, bool_or(same) filter (rank = 1) as top1_correct, round(max(margin) filter (rank = 1), 6) as margin, round(avg(hits / rank) filter (same), 6) as average_precision from rk group by all having sum(same::int) > 0", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.retrieval(_scored(spark, sf))


_OUTCOMES = "(select clip, item, count(*) as n, bool_or(same) filter (rank = 1) as top1, round(avg(hits / rank) filter (same), 6) as ap from rk group by clip, item having sum(same::int) > 0)"


@query("retrieval_summary", f"select count(*) as n_scored, round(avg(top1::int), 4) as rank1, round(avg(ap), 4) as map from {_OUTCOMES}", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.retrieval_summary(P.retrieval(_scored(spark, sf)))


@query("retrieval_breakdown", f"select case when n < 5 then 'few' when n < 12 then 'some' else 'many' end as bin, count(*) as n, round(avg(top1::int), 4) as rank1 from {_OUTCOMES} o group by 1", _PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.retrieval_breakdown(P.retrieval(_scored(spark, sf)), [("few", 0, 5), ("some", 5, 12), ("many", 12, 1e9)])


@query("impostor_llr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.impostor_llr(_scored(spark, sf)).withColumn("llr", F.round("llr", 4))


@query("calibrated_llr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf).withColumn("same", F.col("a_label") == F.col("b_label"))
    return scored.select("clip", "a", "b", F.round(P.Calibrator.fit(scored).column(F.col("score")), 4).alias("llr"))


@query("thread_names")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.features(spark, sf)
    threads = rows.select("clip", F.col("tracklet_id").alias("thread_id"), "start", "end")
    anchors = rows.where("tracklet_id % 3 <> 0").select("clip", F.col("tracklet_id").alias("thread_id"), F.concat(F.lit("home:"), F.col("label").cast("string")).alias("candidate"), (F.col("tracklet_id") % 7).cast("double").alias("log_lr"))
    return P.with_tiers(P.decode_names(threads, anchors, [f"home:{i}" for i in range(10)]))

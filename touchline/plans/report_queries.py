"""Queries over halves' position tables, names, causes of switches and evidence by channel, and the same in DuckDB SQL where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import evaluation as E
from touchline.operators import pairs as P
from touchline.operators import reports as O
from touchline.operators import runs as R
from touchline.plans.tracking_queries import _BEST, _PURITY, _ROWS, _SEGMENTS, _ball, _matches
from touchline.sources import halves as H
from touchline.sources import tracking as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_ROLES = ", ".join(f"'{r}'" for r in H.ROLES)
_HALVES = f"""h as (select 'game_' || (event_id // 400 // 2) || '_H' || (event_id // 400 % 2 + 1) as half_key, event_id as row, event_id % 400 // 10 as frame, event_id % 10 // 5 as side, event_id % 10 % 5 + 1 + event_id % 400 // 200 * 10 as number,
  case when event_id % 7 <> 0 then event_id % 10 % 5 + 1 + event_id % 400 // 200 * 10 end as shirt, case when event_id % 41 <> 0 then case when event_id % 43 = 0 then 14 else event_id % 10 % 5 * 3 + 1 end end as role,
  event_id % 3 <> 0 as seen, event_id * 7 % 1800 as roi_x, event_id * 5 % 1000 as roi_y, case when event_id % 29 <> 0 then event_id % 9 end as class_id from events),
hs as (select *, side * 13 + role - 1 as slot, regexp_replace(half_key, '_H[0-9]*$', '') as game_id, regexp_extract(half_key, '_H([0-9]+)$', 1)::int as half from h where role between 1 and 13),
hev as (select * from hs where class_id <> 0)"""


def query(name: str, sql: str | None = None, base: str = _HALVES):  # noqa: ANN201
    def register(function):  # noqa: ANN001, ANN202
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = f"with {base} {sql}"
        return function

    return register


@query("half_keys", "select half_key, regexp_replace(half_key, '_H[0-9]*$', '') as game_id, regexp_extract(half_key, '_H([0-9]+)$', 1)::int as half, count(*) as n_rows from h group by all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return H.half_keys(S.half_rows(spark, sf))


@query("half_events", f"select half_key, game_id, half, row, frame, side::int as side, role::int as role, slot::int as slot, case when side = 1 then 'R-' else 'L-' end || [{_ROLES}][role] as slot_name, coalesce(shirt, -1) as shirt, class_id::int as class_id, 1.0::double as score, frame / 25 as t, seen as has_box from hev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return H.half_events(S.half_rows(spark, sf))


@query("half_tracklets", "select half_key, (side + 1) * 100 + number as tracklet_id, side + 1 as club, frame, case when first_value(side) over (partition by half_key, (side + 1) * 100 + number order by frame, row) = 0 then 'home' else 'away' end as team, round(roi_x / 3.0::double, 5) as x1, round(roi_y / 3.068181::double, 5) as y1, round((roi_x + 30) / 3.0::double, 5) as x2, round((roi_y + 90) / 3.068181::double, 5) as y2 from h where seen")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return H.half_tracklets(S.half_rows(spark, sf)).withColumns({c: F.round(c, 5) for c in ("x1", "y1", "x2", "y2")})


@query(
    "event_shirts",
    """select v.half_key, v.row, v.slot::int as slot, v.frame, coalesce(arg_max(s.shirt, (s.frame, s.row)) filter (s.frame <= v.frame), arg_min(s.shirt, (s.frame, -s.row)) filter (s.frame > v.frame), -1) as shirt
  from hev v left join (select * from hs where shirt is not null) s on s.half_key = v.half_key and s.slot = v.slot group by v.half_key, v.row, v.slot, v.frame""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.half_rows(spark, sf)
    return H.with_shirts(H.half_events(rows), rows).select("half_key", "row", "slot", "frame", "shirt")


_SUBJECTS = ", subj as (select distinct clip, gt_id, case when gt_id = 3 then 'referee' when gt_id = 2 then 'goalkeeper' else 'player' end as role, case when gt_id % 2 = 0 then 'left' else 'right' end as team, case when gt_id = 1 and clip % 2 = 0 then 'A' else (gt_id + 7)::varchar end as jersey from truth), cand as (select *, case when role in ('player', 'goalkeeper') and regexp_full_match(jersey, '[0-9]+') then team || ':' || jersey end as candidate from subj)"


@query("rosters", "select clip, coalesce(array_to_string(list_sort(list(distinct candidate) filter (candidate is not null)), ','), '') as roster from cand group by clip", _ROWS.rstrip() + _SUBJECTS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return O.roster(S.subjects(spark, sf)).withColumn("roster", F.array_join("roster", ","))


@query(
    "naming_report",
    """, en as (select clip, tracklet_id, majority_gt as gt_id, case when tracklet_id % 5 = 0 then null when tracklet_id % 3 = 0 then (majority_gt + 7)::varchar when tracklet_id % 7 = 0 then 'right:99' else 'left:' || (majority_gt + 7) end as label from pu where majority_gt is not null),
  j as (select en.*, candidate, label is not null and candidate is not null as judged, label is not null and candidate is not null and (label = candidate or label = split_part(candidate, ':', 2)) as good from en left join cand using (clip, gt_id)),
  n as (select clip, count(*) as n_entities, count(label) as n_named, count(*) filter (judged) as n_judged, count(*) filter (good) as n_correct from j group by clip)
  select s.clip, coalesce(n_entities, 0) as n_entities, coalesce(n_named, 0) as n_named, coalesce(n_judged, 0) as n_judged, coalesce(n_correct, 0) as n_correct, round(coalesce(n_named / n_entities, 0), 4) as coverage, round(1 - coalesce(n_named / n_entities, 0), 4) as abstention, round(n_correct / nullif(n_judged, 0), 4) as precision
  from (select clip from cand group by clip having count(candidate) > 0) s left join n using (clip)""",
    (_ROWS + _BEST + _PURITY).rstrip() + _SUBJECTS,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.tracklet_purity(S.detections(spark, sf), S.true_boxes(spark, sf))
    own, who = (F.col("majority_gt") + 7).cast("string"), F.col("tracklet_id")
    label = F.when(who % 5 == 0, F.lit(None)).when(who % 3 == 0, own).when(who % 7 == 0, "right:99").otherwise(F.concat(F.lit("left:"), own))
    return O.naming_report(rows.select("clip", who.alias("entity_id"), F.col("majority_gt").alias("gt_id"), label.alias("label")), S.subjects(spark, sf))


@query("remapped_tracklets", ", lay as (select clip, frame as source, row_number() over (partition by clip order by frame) - 1 as local from (select distinct clip, frame from dets)) select d.clip, d.tracklet_id, lay.source as frame from (select clip, tracklet_id, dense_rank() over (partition by clip order by frame) - 1 as local from dets) d join lay on lay.clip = d.clip and lay.local = d.local", _ROWS.rstrip())
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.detections(spark, sf).select("clip", "tracklet_id", "frame")
    layout = rows.select("clip", F.col("frame").alias("source")).distinct().withColumn("local", F.row_number().over(Window.partitionBy("clip").orderBy("source")) - 1)
    local = rows.join(layout.withColumnRenamed("source", "frame"), ["clip", "frame"]).select("clip", "tracklet_id", F.col("local").cast("long").alias("frame"))
    return O.remapped(local, layout).select("clip", "tracklet_id", "frame")


@query(
    "spotted_possession",
    """, q as (select *, lead(possessor) over (partition by clip order by segment) as nxt from seg), o as (select clip, 'PASS' as class, f as frame, confidence from q where nxt is not null union all select clip, 'RECEPTION', s, confidence from q where nxt is null or n_frames >= 7)
  select clip, class, frame, round(frame / 25, 3) as t, round(confidence, 4) as confidence, cast(null as int) as half from o""",
    (_ROWS + _SEGMENTS).rstrip(),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return O.spotted(R.transition_events(S.possessors(spark, sf)))


def _corroborated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = R.transition_events(S.possessors(spark, sf)).withColumn("event_id", F.col("frame") * 2 + (F.col("type") == "pass").cast("int"))
    touches = R.ball_touches(_ball(spark, sf))
    return E.event_corroboration(events, touches), touches


@query("refined_timing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return O.refined_timing(_corroborated(spark, sf)[0])


@query("corroboration_summary")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return O.corroboration_summary(*_corroborated(spark, sf)).withColumn("by_type", F.to_json("by_type"))


@query("switch_attribution")
def _(spark: SparkSession, sf: str) -> DataFrame:
    matches = _matches(spark, sf)
    entities = matches.withColumn("hyp_id", F.floor(F.col("hyp_id") / 10))
    pristine = matches.withColumn("hyp_id", F.when(F.col("frame") % 50 < 25, F.col("hyp_id")).otherwise(F.col("gt_id")))
    return O.switch_attribution(*(E.switch_instances(m) for m in (matches, entities, pristine)), tolerance=5)


@query("channel_scores")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.scored_pairs(S.features(spark, sf))
    same = rows.withColumn("same", F.col("a_label") == F.col("b_label"))
    gap = (F.col("b_start") - F.col("a_end")) / 25
    body = P.Calibrator.fit(same)
    near, far = P.Calibrator.fit(same.where(gap < 8)), P.Calibrator.fit(same.where(gap >= 8))
    pairs = rows.select("clip", "a", "b", F.when(F.col("a") % 9 != 0, F.col("score")).alias("body"), F.lit(None).cast("double").alias("occupancy"), gap.alias("gap"), F.lit(None).cast("double").alias("transition"))
    scored = O.channel_scores(pairs, {"body": body}, {"body": [(8.0, near), (1e9, far)]}, weights={"body": 0.8}, required=("body",))
    return scored.select("clip", "a", "b", F.round("score", 4).alias("score"), F.round(F.col("channels")[0]["llr"], 4).alias("body_llr"))


@query("lab_rows")
def _(spark: SparkSession, sf: str) -> DataFrame:
    predictions, truth = S.spotted_actions(spark, sf), S.labelled_actions(spark, sf)
    return O.lab_rows(E.verdicts(predictions, truth), predictions, truth)


@query("next_jobs", "jobs as (select o_orderpriority as queue, o_orderkey as job_id, o_orderdate as created from orders where o_orderstatus <> 'F') select queue, job_id, created from jobs qualify row_number() over (partition by queue order by created, job_id) = 1", "")
def _(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued")
    jobs = S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created"))
    return O.first_free(jobs).drop("status")

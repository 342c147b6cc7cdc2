"""Queries over benchmark rows, formations, evidence, trackers, robustness and streams, and the same in DuckDB SQL where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators import association as A
from touchline.operators import benchmark as B
from touchline.operators import evaluation as E
from touchline.operators import evidence as V
from touchline.operators import formation as M
from touchline.operators import governance as Q
from touchline.operators import pairs as P
from touchline.operators import players as L
from touchline.operators import robustness as X
from touchline.operators import runs as R
from touchline.operators import tracker as T
from touchline.operators.pairs import both_ways
from touchline.plans import stages
from touchline.plans.match_queries import _EVENTS, GAP, chained
from touchline.plans.match_queries import ORACLE_SQL as MATCH_SQL
from touchline.sources import files, simulate
from touchline.sources import tracking as S
from touchline.sources.matches import match_events
from touchline.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(function):  # noqa: ANN001, ANN202
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


_BENCH = "with b as (select l_returnflag || l_linestatus as candidate, l_suppkey % 10 as sequence, case when l_linenumber % 2 = 0 then 'test' else 'tuning' end as role, 'quantity' as metric, l_quantity as value from lineitem) "


@query("benchmark_aggregate", _BENCH + "select candidate, metric, role, count(*) as n, round(avg(value), 4) as mean, round(median(value), 4) as median, min(value) as least, max(value) as most from b group by grouping sets ((candidate, metric, role), (candidate, metric))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return B.aggregate(S.benchmark_rows(spark, sf))


@query("benchmark_comparison", _BENCH + ", m as (select candidate, metric, avg(value) as mean from b group by all) select m.candidate, m.metric, round(m.mean, 4) as mean, round(r.mean, 4) as base, round(m.mean - r.mean, 4) as delta, case when m.mean - r.mean > 0.05 then 'improved' when m.mean - r.mean < -0.05 then 'regressed' else 'within_tolerance' end as verdict from m join m r on r.candidate = 'NO' and r.metric = m.metric where m.candidate <> 'NO'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return B.compare(S.benchmark_rows(spark, sf), "NO", 0.05)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued")
    return rows.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("config"), (F.col("o_custkey") % 5).alias("video"), status.alias("status"), F.create_map(F.lit("price"), F.col("o_totalprice")).alias("metrics"))


@query("run_board", "select o_orderpriority as config, o_custkey % 5 as video, 'price' as metric, count(distinct o_orderkey) as n_runs, round(avg(o_totalprice), 6) as mean, min(o_totalprice) as least, max(o_totalprice) as most from orders where o_orderstatus = 'F' group by all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return B.run_board(_runs(spark, sf))


@query("metric_deltas", "with m as (select o_custkey % 5 as v, o_orderpriority as metric, count(*)::double as value from orders group by all) select coalesce(a.metric, b.metric) as metric, a.value as a, b.value as b, round(b.value - a.value, 6) as delta from (select * from m where v = 1) a full join (select * from m where v = 2) b using (metric)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).alias("v"), F.col("o_orderpriority").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return B.metric_deltas(rows.where("v = 1"), rows.where("v = 2"))


@query("config_diff", "with c as (select p_size % 2 as v, p_brand as path, min(p_type) as value from part group by all) select coalesce(a.path, b.path) as path, a.value as a, b.value as b from (select * from c where v = 0) a full join (select * from c where v = 1) b using (path) where a.value is distinct from b.value")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "part").groupBy((F.col("p_size") % 2).alias("v"), F.col("p_brand").alias("path")).agg(F.min("p_type").alias("value"))
    return B.config_diff(rows.where("v = 0"), rows.where("v = 1"))


@query("camera_scores", "with i as (select l_linenumber::int as threshold, l_suppkey % 4 as tp, l_partkey % 3 as fp, l_orderkey % 2 as fn from lineitem) select threshold, round(avg(case when tp + fp + fn > 0 then tp / (tp + fp + fn) else 0 end), 4) as accuracy, round(count(*) / 100000, 4) as completeness, round(round(avg(case when tp + fp + fn > 0 then tp / (tp + fp + fn) else 0 end), 4) * count(*) / 100000, 4) as final from i group by threshold")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("threshold"), (F.col("l_suppkey") % 4).alias("tp"), (F.col("l_partkey") % 3).alias("fp"), (F.col("l_orderkey") % 2).alias("fn"))
    return B.camera_scores(rows, 100_000)


@query("balanced_sample")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return B.balanced_sample(S.labelled_actions(spark, sf), "class_id", 20, "event_id")


_POSITIONS = "pos as (select event_id // 400 as clip, event_id % 20 // 10 as team, event_id % 400 // 20 as frame, event_id % 20 as player_id, (event_id % 20 % 10 // 3 * 20 + 10 + event_id * 7 % 11) / 100 as x, (event_id % 20 * 37 % 90 + event_id * 13 % 7) / 100 as y from events)"


@query("team_centroids", f"with {_POSITIONS} select clip, team, frame, count(*) as n_observed, round(avg(x), 6) as cx, round(avg(y), 6) as cy from pos group by all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.centroids(S.positions(spark, sf)).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


def _relative(spark: SparkSession, sf: str) -> DataFrame:
    return M.relative(S.positions(spark, sf)).withColumns({"rx": F.col("rx") - 0.5, "ry": F.col("ry") - 0.5})


@query("formation_relative", f"with {_POSITIONS}, c as (select clip, team, frame, avg(x) as cx, avg(y) as cy, count(*) as n from pos group by all) select clip, team, frame, player_id, round(case when n >= 3 then 0.5 + x - cx end, 6) as rx, round(case when n >= 3 then 0.5 + y - cy end, 6) as ry from pos join c using (clip, team, frame)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.relative(S.positions(spark, sf)).withColumns({"rx": F.round("rx", 6), "ry": F.round("ry", 6)})


@query("team_spread", f"with {_POSITIONS}, c as (select clip, team, frame, avg(x) as cx, avg(y) as cy from pos group by all) select clip, team, frame, round(sqrt(avg((x - cx) * (x - cx) + (y - cy) * (y - cy))), 6) as spread from pos join c using (clip, team, frame) group by all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.spread(_relative(spark, sf)).withColumn("spread", F.round("spread", 6))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return M.thread_features(_relative(spark, sf)).withColumn("role", (F.col("player_id") % 10 + 1).cast("int"))


@query("role_assignment")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf)
    return M.assign_role(rows, M.role_templates(rows, least=10))


@query("team_role_assignment")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf)
    return M.assign_team_roles(rows, M.role_templates(rows, least=10)).withColumn("cost", F.round("cost", 3))


@query("role_slots")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.role_slots(_relative(spark, sf)).select("clip", "team", "frame", "player_id", "slot")


@query("formation_lines")
def _(spark: SparkSession, sf: str) -> DataFrame:
    slots = M.role_slots(_relative(spark, sf)).where("slot >= 0").select("clip", "team", "slot", "mean_x").distinct()
    return M.formation_lines(slots)


@query("formation_changes")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.formation_changes(M.role_slots(_relative(spark, sf)), every=1)


@query("attack_direction")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sides = S.positions(spark, sf).groupBy("clip", "frame").agg((F.avg(F.when(F.col("team") == 0, F.col("x"))) - F.avg(F.when(F.col("team") == 1, F.col("x")))).alias("gap"))
    return M.attack_direction(sides.withColumn("gap", F.when(F.col("frame") < 10, F.col("gap") + 0.2).otherwise(F.col("gap") - 0.2)), least=4)


_CELLS = f"with {_POSITIONS}, c as (select clip, player_id, least(floor(greatest(0, least(1, y)) * 8), 7) * 12 + least(floor(greatest(0, least(1, x)) * 12), 11) as cell, count(*) as n from pos group by all)"


@query("occupancy", _CELLS + " select clip, player_id, cell::int as cell, n::double as n from c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.occupancy(S.positions(spark, sf), ["clip", "player_id"])
    return rows.select("clip", "player_id", F.posexplode("counts").alias("cell", "n")).where("n > 0")


@query("footprint_distance")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.occupancy(S.positions(spark, sf), ["clip", "player_id"]).withColumn("cells", V.footprint(F.col("counts")))
    a = rows.select("clip", F.col("player_id").alias("a"), F.col("cells").alias("ca"))
    b = rows.select("clip", F.col("player_id").alias("b"), F.col("cells").alias("cb"))
    both = a.join(b, "clip").where("a < b and floor(a / 10) = floor(b / 10)")
    return both.select("clip", "a", "b", F.round(V.js_distance(F.col("ca"), F.col("cb")), 5).alias("distance"), F.round(V.js_distance(V.mirrored(F.col("ca")), F.col("cb")), 5).alias("mirrored"), F.round(V.bimodality(F.col("ca")), 5).alias("bimodality"))


@query("number_prior", "with n as (select event_id % 137 as number from events) select r.number, (count(n.number) + 1.0)::double / (select count(*) + 100.0 from n where number < 100) as p from range(100) r(number) left join n using (number) group by all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.number_prior(S.table(spark, sf, "events").select((F.col("event_id") % 137).alias("number")))


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    row = lambda k: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda c: (1 + (F.col("track") * (k + 3) + e * 5 + c * (F.col("track") % 7 + 1) * 11) % 23) / 200)
    crops = S.table(spark, sf, "events").select(F.floor(e / 400).cast("long").alias("clip"), F.floor(e % 400 / 20).cast("long").alias("track"), "event_id")
    crops = crops.select("clip", "track", V.number_logprobs(F.array(row(0), row(1), row(2))).alias("logprobs"), (1 + e % 3).cast("double").alias("weight"))
    return V.tracklet_numbers(crops, ["clip", "track"])


@query("jersey_numbers")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbers(spark, sf)
    return rows.select("clip", "track", (F.array_position("likelihood", F.array_max("likelihood")) - 1).alias("number"), F.round(F.array_max("likelihood"), 5).alias("likelihood"))


@query("jersey_pairs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbers(spark, sf)
    both = rows.select("clip", F.col("track").alias("a"), F.col("likelihood").alias("la")).join(rows.select("clip", F.col("track").alias("b"), F.col("likelihood").alias("lb")), "clip").where("a < b")
    prior = F.array_repeat(F.lit(0.01), 100)
    return both.select("clip", "a", "b", F.round(V.number_llr(F.col("la"), F.col("lb"), prior), 4).alias("llr"))


@query("thread_states", "with ft as (select vec_id // 40 as clip, vec_id % 40 * 25 as start, vec_id % 40 * 25 + 10 + vec_id * 7 % 30 as stop, label::bigint as label, embedding::double[] as v from embeddings), m as (select clip, label, i, avg(x) as m from (select clip, label, unnest(v) as x, generate_subscripts(v, 1) as i from ft) group by all), l as (select clip, label, sqrt(sum(m * m)) as l from m group by all), s as (select clip, label, round(sum(m / l * (m / l)), 5) as norm from m join l using (clip, label) group by all) select clip, label, sum(stop - start + 1)::bigint as n_frames, count(*) as n_fragments, min(start) as first_start, max(stop) as last_end, max(stop) / 1000 as exit_x, min(start) / 1000 as entry_x, count(v) as n_embedded, any_value(norm) as norm from ft join s using (clip, label) group by clip, label")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.features(spark, sf).withColumns({"n_frames": F.col("end") - F.col("start") + 1, "exit_x": F.col("end") / 1000, "exit_y": F.lit(0.5), "entry_x": F.col("start") / 1000, "entry_y": F.lit(0.5)})
    out = V.thread_states(rows, ["clip", "label"])
    return out.select("clip", "label", "n_frames", "n_fragments", "first_start", "last_end", F.col("exit.exit_x").alias("exit_x"), F.col("entry.entry_x").alias("entry_x"), "n_embedded", F.round(F.aggregate("prototype", F.lit(0.0), lambda s, v: s + v * v), 5).alias("norm"))


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    dt = (e % 300 + 1).cast("double")
    return S.table(spark, sf, "events").select(e, dt.alias("dt"), ((e * 31 % 201 - 100) / 10 * F.sqrt(1 - F.exp(-dt / 60))).alias("dx"), ((e * 17 % 101 - 50) / 10 * F.sqrt(1 - F.exp(-dt / 60))).alias("dy"))


@query("transition_llr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _moves(spark, sf)
    x, y = V.fit_diffusion(rows, "dx"), V.fit_diffusion(rows, "dy")
    return rows.select("event_id", F.round(V.transition_llr(F.col("dt"), F.col("dx"), F.col("dy"), x, y, (20.0, 14.0)), 4).alias("llr"))


@query("iou_tracks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.iou_tracker(S.detections(spark, sf))


@query("feature_splits")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.split_frames(S.frame_features(spark, sf), 0.8)


@query("refined_tracklets")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.refined_tracklets(S.frame_features(spark, sf), 0.9, 0.8, 15)


@query("smoothed_tracks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.positions(spark, sf).select("clip", F.col("player_id").alias("entity"), "frame", (F.col("x") * 10500).alias("x"), (F.col("y") * 6800).alias("y"))
    return T.smoothed_tracks(rows).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    frames = S.true_boxes(spark, sf).select("clip", "frame").distinct()
    f = F.col("frame").cast("double")
    one, none = F.lit(1.0), F.lit(0.0)
    return frames.select("clip", "frame", F.when(F.col("frame") % 9 != 0, F.array(F.array(F.lit(20.0), none, f), F.array(none, F.lit(18.0), F.lit(200.0)), F.array(none, none, one))).alias("homography"), (1 - F.col("frame") % 5 / 10).alias("confidence"))


@query("minimap")
def _(spark: SparkSession, sf: str) -> DataFrame:
    boxes = S.detections(spark, sf)
    entities = boxes.select("clip", "tracklet_id").distinct().where("tracklet_id % 3 <> 0").withColumn("player_id", F.floor(F.col("tracklet_id") / 10))
    return T.minimap(boxes, _calibration(spark, sf), entities)


@query("smoothed_homographies")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.smoothed_homographies(_calibration(spark, sf))
    return rows.select("clip", "frame", F.round(F.col("homography")[0][2], 4).alias("shift"), F.round("confidence", 4).alias("confidence"), "status")


@query("game_state")
def _(spark: SparkSession, sf: str) -> DataFrame:
    calibration = _calibration(spark, sf)
    rows = S.true_boxes(spark, sf).join(calibration.where("homography is not null"), ["clip", "frame"])
    x, y = G.project(F.col("homography"), F.col("x") + F.col("w") / 2, F.col("y") + F.col("h"))
    return T.game_state(rows.select("clip", "frame", "gt_id", x.alias("x"), y.alias("y")), calibration.select("clip", "frame"))


@query("team_colours")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.features(spark, sf).select("clip", "tracklet_id", F.when(F.col("tracklet_id") % 13 == 0, "referee").when(F.col("tracklet_id") % 11 == 0, "goalkeeper").otherwise("player").alias("role"), F.when(F.col("tracklet_id") % 17 != 0, F.transform(F.slice("embedding", 1, 3), lambda v: v + F.col("team"))).alias("colour"))
    return T.team_colours(rows).withColumn("confidence", F.round("confidence", 4))


@query("team_accuracy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.features(spark, sf).select("clip", "tracklet_id", F.lit("player").alias("role"), F.transform(F.slice("embedding", 1, 3), lambda v: v + F.col("team")).alias("colour"), "team")
    key = F.col("clip") * 100 + F.col("tracklet_id")
    truth = rows.select(key.alias("tracklet_id"), F.when(F.col("team") == 0, "left").otherwise("right").alias("side"), (F.col("tracklet_id") % 7 + 1).alias("frames"))
    return T.team_accuracy(T.team_colours(rows.drop("team")).withColumn("tracklet_id", key), truth)


@query("sampled_crops")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.sampled_crops(S.detections(spark, sf))


@query("mot_lines", "with d as (select event_id // 400 as clip, event_id % 400 // 4 as frame, cast((event_id % 4) * 40 + event_id % 400 // 4 * 2 + event_id * 7 % 13 - 6 as double) as x, cast(100 + (event_id % 4) * 3 + event_id * 11 % 9 - 4 as double) as y, cast(60 + (event_id % 4) * 30 + event_id * 5 % 7 - 3 as double) as h, (event_id * 37 % 1000) / 1000 as c from events where event_id % 11 <> 0) select printf('%d,-1,%.2f,%.2f,%.2f,%.2f,%.6f', frame + 1, x, y, 60.0, h, c) as value from d")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return files.mot_lines(S.detections(spark, sf))


@query("crowding", f"with {_EVENTS}, mates as (select e.event_id, e.x + (e.event_id * 17 + j * 41) % 1801 - 900 as ox, e.y + (e.event_id * 29 + j * 57) % 1801 - 900 as oy from ev e, range(1, 4) r(j) where e.event_id % 4 > 1 and j <= e.event_id % 4), around as (select event_id, ox, oy from opp union all select * from mates) select e.match_id, e.event_id, cast((select count(*) from around o where o.event_id = e.event_id and sqrt((ox - e.x) * (ox - e.x) + (oy - e.y) * (oy - e.y)) <= 1000) as int) as crowd from ev e")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.crowding(match_events(spark, sf)).select("match_id", "event_id", "crowd")


def _movements(spark: SparkSession, sf: str) -> DataFrame:
    return X.sheet_sweep(match_events(spark, sf), max_gap=GAP)


@query("sensitivity_sweep")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _movements(spark, sf)


@query("sensitivity_gating")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.gating(_movements(spark, sf))


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    return match_events(spark, sf).select("match_id", F.timestamp_seconds(F.col("t")).alias("ts"), "type")


@query("stream_tumbling", f"with {_EVENTS} select match_id, t // 3600 * 3600 as start_s, count(*) as n_events, count(*) filter (type = 'shot') as n_shots from ev group by all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.tumbling_counts(_timed(spark, sf), 3600)
    return rows.select("match_id", F.unix_seconds("start").alias("start_s"), "n_events", "n_shots")


@query("stream_sessions", f"with {_EVENTS}, s0 as (select match_id, t, t - lag(t) over (partition by match_id order by t) as gap from ev), s1 as (select match_id, t, sum((gap is null or gap > 600)::int) over (partition by match_id order by t rows unbounded preceding) as s from s0) select match_id, min(t) as start_s, max(t) as end_s, count(*) as n_events from s1 group by match_id, s")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.sessions(_timed(spark, sf), 600)
    return rows.select("match_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n_events")


@query("hold_machine")
def _(spark: SparkSession, sf: str) -> DataFrame:
    frames = S.possessors(spark, sf).select("clip", "frame", F.col("possessor").alias("player_id"), "team", (F.col("frame") % 97 == 0).alias("out"))
    return live.possession_events(frames)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return P.scored_pairs(S.features(spark, sf))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.frame_features(spark, sf)
    parts = F.array(*(F.slice("feature", 16 * k + 1, 16) for k in range(4)))
    seen = F.array(*((1 + (F.col("frame") * (k + 3)) % 7) / 7 for k in range(4)))
    return rows.select("clip", "tracklet_id", "frame", parts.alias("parts"), seen.alias("visibility"))


@query("representations")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.representations(_parts(spark, sf), view=0.3).select("clip", "tracklet_id", "prototype", "n_frames", "starved")


@query("part_similarity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    reps = A.representations(_parts(spark, sf), view=0.3)
    ids = reps.select("clip", "tracklet_id").distinct()
    pairs = ids.select("clip", F.col("tracklet_id").alias("a")).join(ids.select("clip", F.col("tracklet_id").alias("b")), "clip").where("a < b")
    return A.part_similarity(pairs, reps).withColumn("score", F.round("score", 5))


@query("reranked_pairs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.reranked(_scored(spark, sf)).withColumn("score", F.round("score", 5))


_PAIR_FEATURES = """with ft as (select vec_id // 40 as clip, vec_id % 40 as tracklet_id, vec_id % 40 * 25 as start, vec_id % 40 * 25 + 10 + vec_id * 7 % 30 as stop, vec_id * 3 % 2 as team, embedding::double[] as v from embeddings),
sc as (select a.clip, a.tracklet_id as a, b.tracklet_id as b, a.start as s1, a.stop as e1, b.start as s2, b.stop as e2, list_cosine_similarity(a.v, b.v) as score from ft a join ft b on a.clip = b.clip and (a.start < b.start or (a.start = b.start and a.tracklet_id < b.tracklet_id)) where b.start - a.stop >= -2 and a.team = b.team),
bw as (select clip, a as item, b as partner, score from sc union all select clip, b, a, score from sc),
rk as (select *, row_number() over w as r, lead(score) over w as second, count(*) over (partition by clip, item) as pool from bw window w as (partition by clip, item order by score desc, partner)),
mg as (select *, case when r = 1 then score - coalesce(second, 0) else -1 end as margin from rk)
select s.clip, s.a, s.b, round(s.score, 5) as score, round(case when x.margin >= 0 and y.margin >= 0 then least(x.margin, y.margin) else -1 end, 5) as margin, case when x.margin >= 0 and y.margin >= 0 then 1.0 else 0.0 end::double as mutual, greatest(0, s2 - e1) / 25 as gap_s, least(e1 - s1, e2 - s2) + 1 as n_frames, least(x.pool, y.pool) as n_candidates
from sc s join mg x on x.clip = s.clip and x.item = s.a and x.partner = s.b join mg y on y.clip = s.clip and y.item = s.b and y.partner = s.a"""


@query("pair_features", _PAIR_FEATURES)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.pair_features(_scored(spark, sf)).withColumns({"score": F.round("score", 5), "margin": F.round("margin", 5)})


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = both_ways(_scored(spark, sf))
    return rows.select((F.col("clip") * 1000 + F.col("item")).alias("episode"), "score", F.col("same").alias("correct"), ((F.col("partner") * 37 % 11) / 11).alias("other"))


@query("fusion_weights")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = A.fusion_weights(_episodes(spark, sf), ["score", "other"])
    return spark.createDataFrame([(k, round(v, 4)) for k, v in found.items()], "channel string, weight double")


@query("merge_frontier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.frontier(_episodes(spark, sf)).withColumn("threshold", F.round("threshold", 5))


@query("merge_hull")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.hull(A.frontier(_episodes(spark, sf))).withColumn("threshold", F.round("threshold", 5))


@query("bootstrap_delta")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.retrieval(_scored(spark, sf)).select(F.col("clip").alias("cluster"), F.col("top1_correct").alias("hit_a"), (F.col("average_precision") > 0.3).alias("hit_b"))
    return A.bootstrap_delta(rows)


@query("zero_wrong_frontier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.zero_wrong(P.merge_counts(P.mutual_best(_scored(spark, sf)), [0.0, 0.2, 0.3, 0.4, 0.5]))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    t, none = F.col("tracklet_id"), F.lit(None)
    return S.features(spark, sf).select(
        "clip", "tracklet_id", "start", "end", F.when(t % 5 != 0, F.col("team")).alias("team"), F.when(t % 9 == 0, F.concat(F.lit("n"), F.col("label").cast("string"))).otherwise(none.cast("string")).alias("anchor"), "embedding",
        (t * 13 % 100 / 100).alias("entry_x"), (t * 29 % 100 / 100).alias("entry_y"), (t * 17 % 100 / 100).alias("exit_x"), (t * 31 % 100 / 100).alias("exit_y"),
    )


@query("four_gates")
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("tracklet_id")
    place = {"start_x": F.col("entry_x") * 10500, "start_y": F.col("entry_y") * 6800, "end_x": F.col("exit_x") * 10500, "end_y": F.col("exit_y") * 6800}
    unit = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(3))) for i in range(3)))
    rows = _evidence(spark, sf).drop("embedding").withColumns(place | {"confidence": F.when(t % 7 != 0, t * 19 % 100 / 100), "homography": F.when(t % 4 != 0, unit)})
    motion = P.motion_reason(calibration=(F.col("a_homography"), F.col("b_homography")))
    gates = [P.overlap_reason(), P.team_reason(0.5), P.anchor_reason(), motion]
    return P.gated(P.pairs(rows), gates).select("clip", "a_tracklet_id", "b_tracklet_id", "reason")


@query("two_pass_threads")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.two_pass_threads(_evidence(spark, sf), body=(8.0, -1.0))


@query("global_pairs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _evidence(spark, sf).select("clip", "tracklet_id", "start", "end", "team", F.lit("player").alias("role"), "embedding", (F.col("entry_x") * 1920).alias("start_x"), (F.col("entry_y") * 1080).alias("start_y"), (F.col("exit_x") * 1920).alias("end_x"), (F.col("exit_y") * 1080).alias("end_y"))
    found = A.global_pairs(P.pairs(rows), 1 - P.cosine(F.col("a_embedding"), F.col("b_embedding")), 0.9, most_gap_s=20.0)
    return found.select("clip", "a_tracklet_id", "b_tracklet_id", "reason", F.round("affinity", 5).alias("affinity"))


@query("oracle_anchors")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.features(spark, sf).select("clip", "tracklet_id", F.concat(F.lit("n"), F.col("label").cast("string")).alias("name"))
    return A.oracle_anchors(rows, 0.6, 0.1, seed=3)


@query("merge_quality")
def _(spark: SparkSession, sf: str) -> DataFrame:
    dets = S.detections(spark, sf)
    threads = dets.select("clip", "tracklet_id").distinct().withColumn("thread_id", F.floor(F.col("tracklet_id") / 20))
    return A.merge_quality(threads, E.composition(dets, S.true_boxes(spark, sf)))


_BOXES = """with ev as (select event_id as e, event_id // 400 as clip, event_id % 400 as pos from events),
truth as (select clip, pos // 4 as frame, e % 4 as gt_id, cast((e % 4) * 40 + pos // 4 * 2 as double) as x, cast(100 + (e % 4) * 3 as double) as y, 60.0::double as w, cast(60 + (e % 4) * 30 as double) as h from ev where e % 23 <> 0),
dets as (select clip, pos // 4 as frame, e as det_id, (case when (pos // 4 // 10) % 5 = 4 then (e % 4 + 1) % 4 else e % 4 end) * 10 + pos // 4 // 25 as tracklet_id, cast((e % 4) * 40 + pos // 4 * 2 + e * 7 % 13 - 6 as double) as x, cast(100 + (e % 4) * 3 + e * 11 % 9 - 4 as double) as y, 60.0::double as w, cast(60 + (e % 4) * 30 + e * 5 % 7 - 3 as double) as h from ev where e % 11 <> 0),
ov as (select d.clip, d.frame, d.det_id, d.tracklet_id, g.gt_id, (greatest(0, least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x)) * greatest(0, least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y))) as inter, d.w * d.h + g.w * g.h as total from dets d join truth g on d.clip = g.clip and d.frame = g.frame),
io as (select *, inter / (total - inter) as iou from ov) """


@query("anchored_subjects", _BOXES + ", v as (select clip, tracklet_id, gt_id, count(distinct frame) as n from io where iou >= 0.3 group by all) select clip, tracklet_id, gt_id, n as n_frames from v qualify row_number() over (partition by clip, tracklet_id order by n desc, gt_id) = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.anchored_subjects(S.detections(spark, sf), S.true_boxes(spark, sf), 0.3)


@query("joined_features", _BOXES + ", a as (select * from io where iou >= 0.3 qualify row_number() over (partition by clip, frame, gt_id order by iou desc, det_id) = 1) select clip, frame, gt_id as tracklet_id, det_id, round(iou, 5) as iou from a qualify row_number() over (partition by clip, frame, det_id order by iou desc, gt_id desc) = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    boxes = S.true_boxes(spark, sf).withColumnRenamed("gt_id", "tracklet_id")
    return A.joined_features(boxes, S.detections(spark, sf).drop("tracklet_id"), 0.3).withColumn("iou", F.round("iou", 5))


@query("gap_anchors", "with f as (select event_id // 400 as clip, event_id % 400 as frame, event_id % 31 < 20 as good from events), g as (select *, max(case when good then frame end) over (partition by clip order by frame rows between unbounded preceding and 1 preceding) as l, min(case when good then frame end) over (partition by clip order by frame rows between 1 following and unbounded following) as r, sum(good::int) over (partition by clip order by frame) as b from f), h as (select *, row_number() over (partition by clip, b order by frame) - 1 as i from g where not good) select clip, frame, unnest(list_filter([l, r], lambda x: x is not null)) as anchor from h where i % 5 = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = S.table(spark, sf, "events").select(F.floor(e / 400).cast("long").alias("clip"), (e % 400).alias("frame"), (e % 31 < 20).alias("good"))
    return A.gap_anchors(rows)


@query("frame_exits")
def _(spark: SparkSession, sf: str) -> DataFrame:
    boxes = S.true_boxes(spark, sf)
    matches = E.best_boxes(S.detections(spark, sf), boxes).groupBy("clip", "gt_id", "frame").agg(F.min("tracklet_id").alias("hyp_id"))
    switches = E.switch_instances(matches).select("clip", "gt_id", (F.col("frame") - 20).alias("from_frame"), F.col("frame").alias("to_frame"))
    return A.frame_exits(switches, boxes, 400.0, 400.0)


@query("cosine_clusters")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.cosine_clusters(S.features(spark, sf).select("clip", F.col("tracklet_id").alias("entity"), "embedding"), 0.3)


@query("serving_diagnostics", "with v as (select case when event_id % 2 = 0 then 'gap' else 'body' end as channel, (event_id * 7 % 100)::double as value from events) select channel, count(*) as n, median(value) as median, min(value) as least, max(value) as most, round(avg((value not between 0 and case when channel = 'gap' then 30 else 80 end)::int), 4) as outside, avg((value not between 0 and case when channel = 'gap' then 30 else 80 end)::int) > 0.5 as flagged from v group by channel")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = S.table(spark, sf, "events").select(F.when(e % 2 == 0, "gap").otherwise("body").alias("channel"), (e * 7 % 100).cast("double").alias("value"))
    return A.serving_diagnostics(rows, {"gap": (0.0, 30.0), "body": (0.0, 80.0)})


_VALUES = ["MIT", "Apache-2.0", "CC  BY 4.0", "synthetic", "AGPL-3.0", "unknown", "bsd-3", "CC-BY-NC 4.0", "custom", "CC BY-NC 4.0", "academic", "self-recorded"]


def _licences(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, _VALUES))
    k = F.col("p_partkey")
    return S.table(spark, sf, "part").select((k % 50).alias("run_id"), F.lit("detect").alias("stage"), F.col("p_brand").alias("model"), F.lit("weights").alias("axis"), F.get(names, (F.floor(k / 50) % F.when(k % 50 < 40, 4).otherwise(12)).cast("int")).alias("value"))


@query("licence_certification", f"with m as (select p_partkey % 50 as run_id, {_VALUES}[(p_partkey // 50) % (case when p_partkey % 50 < 40 then 4 else 12 end) + 1] as v from part), t as (select run_id, trim(regexp_replace(lower(v), '\\s+', ' ', 'g')) as v from m), c as (select run_id, v not in ('', 'unknown') and not regexp_matches(v, 'gpl|non-commercial|noncommercial|non commercial|by-nc|research-only|research only|non-shippable|selection-only|proprietary') and regexp_matches(v, 'apache|mit|bsd|isc|cc0|public domain|public-domain|unlicense|cc by|cc-by|synthetic|owned|self-recorded|permissive') as fine from t) select run_id, bool_and(fine) as passed, count(*) filter (not fine) as n_findings from c group by run_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return Q.certify(_licences(spark, sf))


@query("config_hash")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return Q.config_hash(S.table(spark, sf, "part").select(F.col("p_brand").alias("config"), F.col("p_name").alias("path"), F.col("p_size").cast("string").alias("value")))


@query("clip_pipeline")
def _(spark: SparkSession, sf: str) -> DataFrame:
    boxes = S.detections(spark, sf)
    teams = T.iou_tracker(boxes).select("clip", F.col("track_id").alias("tracklet_id"), (F.col("track_id") % 2).alias("team")).distinct()
    return stages.run(boxes, S.ball(spark, sf), teams)["events"]


@query("player_coverage", "select event_id // 400 as clip, event_id % 20 as player_id, count(*) filter (event_id % 13 <> 0) as observed_frames, any_value(t.n) as total_frames, round(count(*) filter (event_id % 13 <> 0) / any_value(t.n), 4) as observed_fraction from events join (select event_id // 400 as c, count(distinct event_id % 400 // 20) as n from events group by all) t on t.c = event_id // 400 group by 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = S.table(spark, sf, "events").select(F.floor(e / 400).cast("long").alias("clip"), F.floor(e % 400 / 20).cast("long").alias("frame"), (e % 20).alias("player_id"), (e % 13 != 0).alias("seen"))
    return L.coverage(rows)


@query("class_counts", "select (event_id // 3 % 4 + 1)::int as class_id, (event_id // 12 % 3)::int as slot, count(*) as n, count(*) filter (event_id % 5 <> 0) as with_box from events where event_id % 3 = 0 group by all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.class_counts(S.labelled_actions(spark, sf).where("event_id % 3 = 0"))  # as the SQL does


@query("tier_one_abstentions", f"select match_id, half, p.* exclude (match_id, half), g.skipped_no_actor as moves_no_actor, g.skipped_no_end as moves_no_end, g.* exclude (match_id, half, skipped_no_actor, skipped_no_end) from ({MATCH_SQL['passing_exclusions']}) p full join ({MATCH_SQL['progression_exclusions']}) g using (match_id, half)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.abstentions(chained(spark, sf))


@query("possession_sheet")
def _(spark: SparkSession, sf: str) -> DataFrame:
    timeline = S.possessors(spark, sf)
    frames = timeline.select("clip", "frame", F.col("possessor").alias("player_id"), "team", (F.col("frame") % 97 == 0).alias("out"))
    return R.possession_sheet(live.possession_events(frames), R.possession_segments(timeline))


@query("simulated_match")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = simulate.players(spark, 500, seed=7)
    ball = simulate.possessor(spark.range(500).select(F.col("id").alias("frame")), seed=7)
    return rows.join(ball.withColumn("has_ball", F.lit(True)), ["frame", "player_id"], "left").select("frame", "team", "player_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.coalesce("has_ball", F.lit(False)).alias("has_ball"))


@query("synthetic_detections")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.detections(simulate.players(spark, 500, seed=7), seed=7)


@query("oracle_detections")
def _(spark: SparkSession, sf: str) -> DataFrame:
    truth = S.true_boxes(spark, sf)
    return E.detection_report(E.match_frames(simulate.oracle(truth, 1, 0.1, 3.0), truth), truth)


@query("reprojected_points")
def _(spark: SparkSession, sf: str) -> DataFrame:
    marks = [(x, y) for x in (0.0, 1650.0, 5250.0, 8850.0, 10500.0) for y in (0.0, 1384.0, 3400.0, 5416.0, 6800.0)]
    rows = _calibration(spark, sf).where("homography is not null")
    return rows.select("clip", "frame", F.posexplode(G.reprojected(F.col("homography"), marks, 1920.0, 1080.0)).alias("mark", "p")).select("clip", "frame", "mark", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("team_gate_behaviour")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.features(spark, sf)
    team = F.when(F.col("tracklet_id") % 6 == 0, "unknown").when((F.col("team") + F.col("tracklet_id") % 9 / 8).cast("int") % 2 == 0, "home").otherwise("away")
    return T.gate_behaviour(rows.select("clip", "tracklet_id", "start", "end", team.alias("team"), (F.col("tracklet_id") % 10 / 10).alias("confidence"), F.col("label").alias("gt_id"), F.when(F.col("team") == 0, "left").otherwise("right").alias("gt_team")))

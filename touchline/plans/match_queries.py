"""Queries over the match event stream, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators import chains, duels, models, players, sequences, teams
from touchline.sources.matches import DRIVER_GAP, match_events

GAP = DRIVER_GAP
QUERIES: dict = {}
ORACLE_SQL: dict = {}

_EVENTS = """
ev0 as (
  select datediff('day', date '1970-01-01', cast(ts as date)) as match_id, cast(hour(ts) // 12 as int) + 1 as half, event_id,
    datediff('day', date '1970-01-01', cast(ts as date)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) as bigint) as t,
    ['pass','pass','carry','pass','cross','shot','header','tackle','carry','block','throw_in','pass'][(event_id * 7 + cast(json_extract_string(props, '$.k') as bigint)) % 12 + 1] as type,
    case when event_id % 17 <> 0 then user_id end as player_id, user_id % 2 as club_id, case when user_id < 2 then 1 else user_id % 10 + 2 end as role,
    cast((cast(json_extract_string(props, '$.k') as bigint) * 97 + event_id * 131) % 10501 as double) as x,
    cast((cast(json_extract_string(props, '$.k') as bigint) * 53 + event_id * 71) % 6801 as double) as y,
    event_id % 29 = 0 as replay
  from events),
ev1 as (select *, lead(t) over w as nt, lead(x) over w as nx, lead(y) over w as ny, lead(club_id) over w as nc from ev0 window w as (partition by match_id, half, replay order by t, event_id)),
ev as (select match_id, half, event_id, t, type, player_id, club_id, role, x, y, replay,
    case when type <> 'shot' and nt - t <= 600 then case when nc = club_id then nx else 10500 - nx end end as end_x,
    case when type <> 'shot' and nt - t <= 600 then case when nc = club_id then ny else 6800 - ny end end as end_y
  from ev1),
opp as (select e.match_id, e.event_id, e.x + (e.event_id * 17 + j * 37) % 1801 - 900 as ox, e.y + (e.event_id * 29 + j * 53) % 1801 - 900 as oy from ev e, range(1, 4) r(j) where j <= e.event_id % 4)
"""

_CHAINS = (
    _EVENTS
    + """,
c1 as (select *, lag(half) over w as hb, lag(t) over w as tb from ev where not replay window w as (partition by match_id order by half, t, event_id)),
c2 as (select *, hb is null or hb <> half or t - tb > 600 as cut, type in ('tackle','block','header') as contest, type in ('pass','cross','carry','shot','throw_in','take_on') as holds from c1),
c3 as (select *, sum(cut::int) over (partition by match_id order by half, t, event_id) as seg from c2),
c4 as (select *, last_value(case when cut or not contest then club_id end ignore nulls) over (partition by match_id, seg order by half, t, event_id rows between unbounded preceding and 1 preceding) as holder from c3),
c5 as (select *, sum((cut or (holder <> club_id and not contest))::int) over (partition by match_id order by half, t, event_id)::bigint - 1 as chain_id from c4),
c6 as (select *, first_value(club_id) over (partition by match_id, chain_id order by half, t, event_id) as chain_club,
    first_value(case when holds then event_id end ignore nulls) over (partition by match_id order by half, t, event_id rows between 1 following and unbounded following) as next_id from c5),
ch as (select c6.*, row_number() over (partition by c6.match_id order by c6.half, c6.t, c6.event_id) as place,
    case when c6.type not in ('pass','cross','carry','throw_in') then 'unknown' when n.half = c6.half and n.t - c6.t <= 600 then case when n.club_id = c6.club_id then 'complete' else 'incomplete' end else 'unknown' end as outcome
  from c6 left join ev n on n.event_id = c6.next_id),
ct as (select match_id, chain_id, any_value(chain_club) as club_id, count(*) as n_events, min(place) as p0, max(place) as p1, min(case when club_id = chain_club then place end) as o0,
    max(case when club_id = chain_club then place end) as o1, count(*) filter (club_id = chain_club and type in ('pass','cross')) as n_own_passes,
    coalesce(bool_or(holds) filter (club_id = chain_club), false) as held
  from ch group by match_id, chain_id),
pc as (select a.match_id, a.chain_id, a.o1 as lost, b.o0 as won from ct a join ct b on a.match_id = b.match_id and b.chain_id = a.chain_id + 1
  join ch l on l.match_id = a.match_id and l.place = a.p1 join ch f on f.match_id = a.match_id and f.place = b.p0
  where a.club_id <> b.club_id and l.half = f.half and f.t - l.t <= 600 and a.held and b.held)
"""
)


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.with_chains(match_events(spark, sf_dir), GAP)


def query(name: str, sql: str | None = None, base: str | None = _CHAINS):  # noqa: ANN201
    """Register a query over chained events, with its SQL over the common parts."""

    def register(function):  # noqa: ANN001, ANN202
        QUERIES[name] = lambda spark, sf_dir: function(chained(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"with {base} {sql}"
        return function

    return register


def _direction(a: str = "") -> str:
    angle = "degrees(atan2(abs(end_y - y), end_x - x))"
    return f"case when end_x = x and end_y = y then 'lateral' when {angle} <= 75 then 'forward' when {angle} >= 105 then 'back' else 'lateral' end{a}"


def _goal(x: str, y: str) -> str:
    return f"sqrt((10500 - {x}) * (10500 - {x}) + (3400 - {y}) * (3400 - {y}))"


def _box(x: str, y: str) -> str:
    return f"({x} >= 8850 and abs({y} - 3400) <= 2016)"


@query("pass_completion_by_player", "select match_id, player_id, count(*) as attempted, count(*) filter (outcome = 'complete') as completed, round(count(*) filter (outcome = 'complete') / count(*), 4) as completion_rate from ch where type in ('pass','cross') and outcome <> 'unknown' and player_id is not null and end_x is not null group by all")
def _(ch: DataFrame) -> DataFrame:
    return players.pass_completion(ch)


@query("event_outcomes", "select match_id, type, outcome, count(*) as n from ch group by all")
def _(ch: DataFrame) -> DataFrame:
    return ch.groupBy("match_id", "type", "outcome").agg(F.count("*").alias("n"))


@query("chained_events", "select c.match_id, c.event_id, c.chain_id, c.chain_club, c.outcome, case when c.type in ('pass','cross','throw_in') and c.outcome = 'complete' and (c.player_id is null or n.player_id <> c.player_id) then n.player_id end as receiver_id from ch c left join ev n on n.event_id = c.next_id")
def _(ch: DataFrame) -> DataFrame:
    return ch.select("match_id", "event_id", "chain_id", "chain_club", "outcome", "receiver_id")


@query("chain_summary", "select match_id, club_id, count(*) as n_chains, sum(n_events)::bigint as n_events, max(n_events) as longest_chain, sum(n_own_passes)::bigint as n_own_passes from ct group by all")
def _(ch: DataFrame) -> DataFrame:
    return chains.chain_summary(ch)


@query("possession_changes", "select match_id, chain_id from pc")
def _(ch: DataFrame) -> DataFrame:
    return chains.possession_changes(chains.chain_table(ch), GAP).select("match_id", "chain_id")


_PASS_SPLITS = {
    "_attempted": "true", "_forward": "d = 'forward'", "_lateral": "d = 'lateral'", "_back": "d = 'back'", "_defensive_third": "x < 3500", "_middle_third": "x >= 3500 and x < 7000", "_final_third": "x >= 7000",
    "_under_pressure": "near <= 500", "_not_under_pressure": "near > 500", "_pressure_unknown": "near is null",
}
_PASS_COLUMNS = ", ".join(f"count(*) filter ({c}) as passes{k}, count(*) filter ({c} and outcome = 'complete') as passes{'' if k == '_attempted' else k}_completed" for k, c in _PASS_SPLITS.items())
_PASSES = f"""select match_id, half, player_id, club_id, {_PASS_COLUMNS} from (select *, {_direction()} as d, (select min(sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y))) from opp o where o.event_id = ch.event_id) as near
  from ch where type in ('pass','cross') and outcome <> 'unknown' and player_id is not null and end_x is not null) group by all"""


@query("passing_by_player", _PASSES)
def _(ch: DataFrame) -> DataFrame:
    return players.passing(ch)


@query("passing_exclusions", "select match_id, half, count(*) filter (outcome = 'unknown') as excluded_unknown_outcome, count(*) filter (outcome <> 'unknown' and player_id is null) as skipped_no_actor, count(*) filter (outcome <> 'unknown' and player_id is not null and end_x is null) as skipped_no_end, count(*) filter (outcome <> 'unknown' and player_id is not null and end_x is not null and event_id % 4 = 0) as pressure_unknown from ch where type in ('pass','cross') group by all")
def _(ch: DataFrame) -> DataFrame:
    return players.passing_exclusions(ch)


_GAIN = f"{_goal('x', 'y')} - {_goal('end_x', 'end_y')}"
_BARRED = "case when type = 'carry' then end_x < 5250 else x < 4200 end"
_PROGRESSION = f"""select match_id, half, player_id, club_id,
  count(*) filter (move and pass_like and prog) as progressive_passes, count(*) filter (move and type = 'carry' and prog) as progressive_carries,
  round(coalesce(sum(greatest(gained, 0)) filter (move), 0), 3) as progressive_distance_cm, round(coalesce(sum(greatest(gained, 0)) filter (move and pass_like), 0), 3) as progressive_passing_distance_cm,
  round(coalesce(sum(greatest(gained, 0)) filter (move and type = 'carry'), 0), 3) as progressive_carrying_distance_cm,
  count(*) filter (move and pass_like and into_third) as final_third_entries_pass, count(*) filter (move and type = 'carry' and into_third) as final_third_entries_carry,
  count(*) filter (move and pass_like and into_box) as box_entries_pass, count(*) filter (move and type = 'pass' and into_box) as box_entries_open_pass, count(*) filter (move and type = 'cross' and into_box) as box_entries_cross,
  count(*) filter (move and type = 'carry' and into_box) as box_entries_carry, count(*) filter (in_box) as touches_in_opp_box
from (select *, type in ('pass','cross') as pass_like, type in ('pass','cross','carry') and end_x is not null and outcome = 'complete' as move, {_GAIN} as gained,
   not {_BARRED} and ({_box('end_x', 'end_y')} or {_GAIN} >= 914.4) as prog, x < 7000 and end_x >= 7000 as into_third, not {_box('x', 'y')} and {_box('end_x', 'end_y')} as into_box, {_box('x', 'y')} as in_box
  from ch where player_id is not null) group by all having count(*) filter (move) > 0 or count(*) filter (in_box) > 0"""


@query("progression_by_player", _PROGRESSION)
def _(ch: DataFrame) -> DataFrame:
    return players.progression(ch)


@query(
    "progression_exclusions",
    f"""select match_id, half, count(*) filter (player_id is null) as skipped_no_actor, count(*) filter (m and player_id is not null and end_x is null) as skipped_no_end,
  count(*) filter (w and outcome = 'incomplete') as excluded_incomplete, count(*) filter (w and outcome = 'unknown') as abstained_unknown_outcome,
  count(*) filter (w and outcome = 'complete' and type <> 'carry' and far and x < 4200) as passes_excluded_defending_40pct, count(*) filter (w and outcome = 'complete' and type = 'carry' and far and end_x < 5250) as carries_excluded_own_half
from (select *, type in ('pass','cross','carry') as m, type in ('pass','cross','carry') and player_id is not null and end_x is not null as w, {_GAIN} >= 914.4 as far from ch) group by all""",
)
def _(ch: DataFrame) -> DataFrame:
    return players.progression_exclusions(ch)


_WALK = """, walk as (select e.*, s.event_id as shot_event_id, s.club_id as shot_club, s.player_id as shooter_id, s.place as shot_place from ch e join ch s on s.match_id = e.match_id and s.chain_id = e.chain_id and s.type = 'shot' and e.place < s.place),
kp as (select match_id, chain_id, event_id as pass_event_id, shot_event_id, club_id, player_id as passer_id, shooter_id, type from walk
  where shooter_id is not null and not contest and not (type = 'carry' and club_id = shot_club and player_id is not distinct from shooter_id) qualify row_number() over (partition by match_id, shot_event_id order by place desc) = 1),
key_pass as (select k.* exclude (type) from kp k join ev s on s.event_id = k.shot_event_id where k.club_id = s.club_id and k.type in ('pass','cross') and k.passer_id <> k.shooter_id),
sc as (select *, row_number() over w as ord, coalesce(sum((type in ('shot','throw_in'))::int) over (partition by match_id, shot_event_id order by place desc rows between unbounded preceding and 1 preceding), 0) as ended
  from walk where club_id = shot_club and type in ('pass','cross','carry','take_on','foul_won','shot','throw_in') window w as (partition by match_id, shot_event_id order by place desc)),
sca as (select match_id, chain_id, event_id as action_event_id, shot_event_id, club_id, player_id, type as action_type, ord from sc where ord <= 2 and ended = 0 and player_id is not null)
"""


@query("key_passes", "select * from key_pass", _CHAINS + _WALK)
def _(ch: DataFrame) -> DataFrame:
    return players.key_passes(ch).drop("xa")


@query("shot_creating_actions", 'select match_id, chain_id, action_event_id, shot_event_id, club_id, player_id, action_type, cast(ord as int) as "order" from sca', _CHAINS + _WALK)
def _(ch: DataFrame) -> DataFrame:
    return players.shot_creating_actions(ch)


@query("creation_by_player", "select match_id, player_id, club_id, sum(kp)::bigint as key_passes, sum(s)::bigint as sca from (select match_id, passer_id as player_id, club_id, 1 as kp, 0 as s from key_pass union all select match_id, player_id, club_id, 0, 1 from sca) group by all", _CHAINS + _WALK)
def _(ch: DataFrame) -> DataFrame:
    return players.creation(ch).select("match_id", "player_id", "club_id", "key_passes", "sca")


@query("sca_by_club", "select match_id, club_id, count(*) as sca from sca group by all", _CHAINS + _WALK)
def _(ch: DataFrame) -> DataFrame:
    return players.sca_by_club(ch)


_DUELS = """, gd0 as (select *, last_value(case when holds then event_id end ignore nulls) over (partition by match_id, half order by t, event_id rows between unbounded preceding and 1 preceding) as b,
   first_value(case when holds then event_id end ignore nulls) over (partition by match_id, half order by t, event_id rows between 1 following and unbounded following) as a from ch),
gd as (select g.match_id, g.half, g.event_id, g.club_id as a_club, g.player_id as a_player, b.club_id as b_club, b.player_id as b_player, case when a.t - g.t <= 600 then a.club_id end as winner_club
  from gd0 g join ev b on b.event_id = g.b left join ev a on a.event_id = g.a where g.type in ('tackle','block') and g.t - b.t <= 600 and b.club_id <> g.club_id)
"""


@query("ground_duels", "select * from gd", _CHAINS + _DUELS)
def _(ch: DataFrame) -> DataFrame:
    return duels.ground_duels(ch, GAP).select("match_id", "half", "event_id", "a_club", "a_player", "b_club", "b_player", "winner_club")


@query("ground_duels_by_player", "select match_id, player_id, club_id, count(*) filter (w is not null) as ground_duels, count(*) filter (w = club_id) as ground_duels_won, count(*) filter (w is null) as ground_duels_unresolved from (select match_id, a_player as player_id, a_club as club_id, winner_club as w from gd union all select match_id, b_player, b_club, winner_club from gd) where player_id is not null group by all", _CHAINS + _DUELS)
def _(ch: DataFrame) -> DataFrame:
    return duels.by_participant(duels.ground_duels(ch, GAP), ["match_id"]).select("match_id", "player_id", "club_id", "ground_duels", "ground_duels_won", "ground_duels_unresolved")


@query("aerial_duels")
def _(ch: DataFrame) -> DataFrame:
    return duels.aerial_duels(ch, 600.0, GAP)


@query("aerial_window_sweep")
def _(ch: DataFrame) -> DataFrame:
    return duels.aerial_window_sweep(ch, (60.0, 300.0, 600.0), GAP)


_BEATEN = "(select count(*) from opp o where o.event_id = c.event_id and ox > c.x and ox < c.end_x and sqrt((ox - c.x) * (ox - c.x) + (oy - c.y) * (oy - c.y)) <= 900)"


@query("take_ons", f"select match_id, event_id, player_id, completed, beaten as beaten_opponents from (select match_id, event_id, player_id, outcome = 'complete' as completed, cast({_BEATEN} as int) as beaten from ch c where type = 'carry' and end_x is not null) where beaten > 0")
def _(ch: DataFrame) -> DataFrame:
    return duels.take_ons(ch, 900.0).select("match_id", "event_id", "player_id", "completed", "beaten_opponents")


@query("take_on_rate", f"select match_id, count(*) filter (beaten > 0) as take_ons, count(*) as carries, round(count(*) filter (beaten > 0) / count(*), 4) as take_on_rate from (select match_id, {_BEATEN} as beaten from ch c where type = 'carry') group by all")
def _(ch: DataFrame) -> DataFrame:
    return duels.take_on_rate(ch, 900.0)


@query("take_on_null_rates")
def _(ch: DataFrame) -> DataFrame:
    return duels.take_on_null_rates(ch, radius=900.0)


_BALLS = """, balls as (select 'turnover' as kind, c.*, coalesce(c.end_x, c.x) as bx from pc join ch c on c.match_id = pc.match_id and c.place = pc.lost union all select 'recovery', c.*, c.x from pc join ch c on c.match_id = pc.match_id and c.place = pc.won)"""


@query("recoveries_and_turnovers", "select match_id, kind, half, event_id, player_id, club_id, case when bx < 3500 then 'defensive' when bx < 7000 then 'middle' else 'final' end as third from balls", _CHAINS + _BALLS)
def _(ch: DataFrame) -> DataFrame:
    return duels.ball_events(ch, max_gap=GAP).select("match_id", "kind", "half", "event_id", "player_id", "club_id", "third")


@query("balls_by_third", "select match_id, kind, count(*) filter (bx < 3500) as defensive, count(*) filter (bx >= 3500 and bx < 7000) as middle, count(*) filter (bx >= 7000) as final from balls group by all", _CHAINS + _BALLS)
def _(ch: DataFrame) -> DataFrame:
    return duels.counts_by_third(duels.ball_events(ch, max_gap=GAP))


_LANE = """(select case when count(*) > 0 then count(*) filter (not (least(d1, d2, d3) < 0 and greatest(d1, d2, d3) > 0)) end from (select (s.x - ox) * (3034 - oy) - (s.y - oy) * (10500 - ox) as d1, (10500 - ox) * (3766 - oy) - (3034 - oy) * (10500 - ox) as d2, (10500 - ox) * (s.y - oy) - (3766 - oy) * (s.x - ox) as d3 from opp o where o.event_id = s.event_id))"""
_SHOTS = f""", sh0 as (select s.*, greatest(0.5, (10500 - x) / 100) as x_m, abs(y - 3400) / 100 as c_m, {_LANE} as lane, lag(type) over w as before_type, lag(chain_id) over w as before_chain from ch s window w as (partition by match_id order by place)),
sh1 as (select *, case when before_chain = chain_id and before_type = 'throw_in' then true end as origin, atan2(7.32 * x_m, x_m * x_m + c_m * c_m - 3.66 * 3.66) as a0 from sh0 where type = 'shot'),
sh2 as (select *, case when a0 < 0 then a0 + pi() else a0 end as angle from sh1),
sh as (select *, 1 / (1 + exp(-(0.5103 + 0.6338 * angle - 0.2798 * sqrt(x_m * x_m + c_m * c_m) + 0.1243 * x_m - 0.03 * c_m + 0.0014 * x_m * x_m + 0.0041 * c_m * c_m - 0.1251 * angle * x_m - 0.3 * (case when origin then 1 else 0 end) - 0.25 * greatest(0, coalesce(lane, 1) - 1)))) as xg from sh2)
"""


@query("shots_xg", "select match_id, event_id, cast(lane as int) as lane, origin as set_piece_origin, round(xg, 4) as xg from sh", _CHAINS + _SHOTS)
def _(ch: DataFrame) -> DataFrame:
    return models.shots(ch).select("match_id", "event_id", "lane", F.col("origin").alias("set_piece_origin"), F.round("xg", 4).alias("xg"))


@query("xg_by_player", "select match_id, player_id, count(*) as shots, round(sum(xg), 4) as xg from sh where player_id is not null group by all", _CHAINS + _SHOTS)
def _(ch: DataFrame) -> DataFrame:
    return models.shot_sheet(ch)


@query("shot_origins", "select match_id, count(*) filter (origin) as shots_from_set_piece, round(coalesce(sum(xg) filter (origin), 0), 4) as xg_from_set_piece, cast(null as bigint) as shots_open_play, cast(null as double) as xg_open_play, count(*) filter (origin is null) as shots_unattributable from sh group by all", _CHAINS + _SHOTS)
def _(ch: DataFrame) -> DataFrame:
    return teams.shot_origins(ch)


@query("pass_share_percentile", "select match_id, player_id, n, round(case when m = 1 then 50.0 else 100.0 * (r - 1 + (k - 1) / 2.0) / (m - 1) end, 4) as percentile from (select *, rank() over (partition by match_id order by n) as r, count(*) over (partition by match_id, n) as k, count(*) over (partition by match_id) as m from (select match_id, player_id, count(*) as n from ch where type = 'pass' and player_id is not null group by all))")
def _(ch: DataFrame) -> DataFrame:
    counts = ch.where("type = 'pass' and player_id is not null").groupBy("match_id", "player_id").agg(F.count("*").alias("n"))
    return models.midrank(counts, "n", ["match_id"]).withColumn("percentile", F.round("percentile", 4))


_ZONE = lambda x, y: f"greatest(0, least(11, trunc({y} / 6800 * 12))) * 16 + greatest(0, least(15, trunc({x} / 10500 * 16)))"


@query("xt_zone_counts", f"select cast({_ZONE('x', 'y')} as int) as zone, count(*) filter (type = 'shot') as shots, count(*) filter (type <> 'shot' and outcome <> 'unknown') as moves, count(*) filter (type <> 'shot' and outcome = 'complete' and end_x is not null) as completed from ch where type in ('shot','pass','cross','carry','throw_in') group by 1")
def _(ch: DataFrame) -> DataFrame:
    return models.zone_counts(ch)


@query("xt_transitions", f"select cast({_ZONE('x', 'y')} as int) as zone, cast({_ZONE('end_x', 'end_y')} as int) as to_zone, count(*) as n from ch where type in ('pass','cross','carry','throw_in') and outcome = 'complete' and end_x is not null group by 1, 2")
def _(ch: DataFrame) -> DataFrame:
    return models.transitions(ch)


@query("xt_by_player")
def _(ch: DataFrame) -> DataFrame:
    return models.threat_by_player(models.credit_moves(ch, models.fit_threat(ch)))


@query("xt_by_player_completed_only")
def _(ch: DataFrame) -> DataFrame:
    return models.threat_by_player(models.credit_moves(ch, models.fit_threat(ch, failures_absorb=False)))


@query("xt_top_actions")
def _(ch: DataFrame) -> DataFrame:
    return models.top_actions(models.credit_moves(ch, models.fit_threat(ch))).select("match_id", "rank", "event_id", "player_id", F.round("worth", 5).alias("worth"))


@query("momentum")
def _(ch: DataFrame) -> DataFrame:
    return models.momentum(models.credit_moves(ch, models.fit_threat(ch)), 3600.0, 60.0)


@query("final_third_touches", "select match_id, club_id, count(*) filter (x >= 7000) as touches from ch group by all")
def _(ch: DataFrame) -> DataFrame:
    return teams.final_third_touches(ch)


@query("field_tilt", "select match_id, club_id, touches, cast(sum(touches) over (partition by match_id) as bigint) as total_touches, round(touches / nullif(sum(touches) over (partition by match_id), 0), 4) as field_tilt from (select match_id, club_id, count(*) filter (x >= 7000) as touches from ch group by all)")
def _(ch: DataFrame) -> DataFrame:
    return teams.field_tilt(ch)


_PPDA = """, pp as (select match_id, half, p.c as pressing_club, z.zone, count(*) filter (club_id <> p.c and type in ('pass','cross') and 10500 - x > z.line) as opponent_passes, count(*) filter (club_id = p.c and type = 'tackle' and x > z.line) as tackles, count(*) filter (club_id = p.c and type = 'block' and x > z.line) as blocks
  from ch, (values (0), (1)) p(c), (values ('trainor', 4200.0::double), ('opta', 3500.0::double)) z(zone, line) group by all)"""


@query("ppda_components", "select match_id, half, pressing_club::bigint as pressing_club, zone, opponent_passes, tackles, blocks, tackles + blocks as defensive_actions, cast(null as double) as ppda from pp", _CHAINS + _PPDA)
def _(ch: DataFrame) -> DataFrame:
    return teams.ppda_team_half(teams.ppda_components(ch))


@query("ppda_pooled", "select pressing_club::bigint as pressing_club, zone, sum(opponent_passes)::bigint as opponent_passes, sum(tackles + blocks)::bigint as defensive_actions, round(sum(opponent_passes) / nullif(sum(tackles + blocks), 0), 4) as ppda from pp group by all", _CHAINS + _PPDA)
def _(ch: DataFrame) -> DataFrame:
    return teams.ppda_pooled(teams.ppda_components(ch))


@query("keepers", "select match_id, half, club_id, count(distinct player_id) as n_keepers, case when count(distinct player_id) = 1 then max(player_id) end as keeper_id from ch where role = 1 and player_id is not null group by all")
def _(ch: DataFrame) -> DataFrame:
    return teams.keepers(ch)


@query("keeper_sheet")
def _(ch: DataFrame) -> DataFrame:
    return teams.keeper_sheet(ch)


@query("unattributed_shots", "select s.match_id, s.half, count(*) as n_shots, count(*) filter (k.club_id is null) as unattributed from ch s left join (select k.match_id, k.half, k.club_id from ch k join (select match_id, half from ch group by all having count(distinct club_id) = 2) two on two.match_id = k.match_id and two.half = k.half where k.role = 1 and k.player_id is not null group by all having count(distinct k.player_id) = 1) k on k.match_id = s.match_id and k.half = s.half and k.club_id = 1 - s.club_id where s.type = 'shot' group by all")
def _(ch: DataFrame) -> DataFrame:
    return teams.unattributed_shots(ch)


@query("throw_in_takers", "select match_id, player_id, club_id, type, count(*) filter (outcome <> 'unknown') as attempted, count(*) filter (outcome = 'complete') as completed, count(*) filter (outcome = 'unknown') as unknown, round(case when count(*) filter (outcome <> 'unknown') >= 10 then count(*) filter (outcome = 'complete') / count(*) filter (outcome <> 'unknown') end, 4) as completion_rate from ch where type = 'throw_in' and player_id is not null group by all")
def _(ch: DataFrame) -> DataFrame:
    return teams.takers(ch)


@query("set_piece_restarts", "select m.match_id, r.restart, case when restart = 'throw_in' then n end as taken, case when restart = 'throw_in' then att end as attempted, case when restart = 'throw_in' then comp end as completed, case when restart = 'throw_in' then unk end as unknown, round(case when restart = 'throw_in' and att >= 10 then comp / att end, 4) as completion_rate from (select match_id, count(*) filter (type = 'throw_in') as n, count(*) filter (type = 'throw_in' and outcome <> 'unknown') as att, count(*) filter (type = 'throw_in' and outcome = 'complete') as comp, count(*) filter (type = 'throw_in' and outcome = 'unknown') as unk from ch group by all) m, (values ('corner'), ('free_kick'), ('goal_kick'), ('penalty'), ('throw_in')) r(restart)")
def _(ch: DataFrame) -> DataFrame:
    return teams.restarts(ch)


@query("corner_candidates", "select match_id, half, event_id, club_id, round(d, 3) as flag_distance from (select *, t - lag(t) over (partition by match_id, half order by t, event_id) as gap, sqrt((10500 - x) * (10500 - x) + least(y * y, (6800 - y) * (6800 - y))) as d from ch) where type = 'cross' and d <= 3000 and coalesce(gap, 1e18) > 300")
def _(ch: DataFrame) -> DataFrame:
    return teams.corner_candidates(ch, radius=3000.0, min_gap=300.0).select("match_id", "half", "event_id", "club_id", F.round("flag_distance", 3).alias("flag_distance"))


@query("corner_null_test")
def _(ch: DataFrame) -> DataFrame:
    return teams.corner_null_test(ch, radius=3000.0, min_gap=300.0)


_SEQ = f""", sq0 as (select c.*, f.t as first_t, f.half as first_half, f.type as first_type, f.club_id as first_club, l.t as last_t, l.half as last_half, lo.type as last_own_type from ct c join ch f on f.match_id = c.match_id and f.place = c.p0 join ch l on l.match_id = c.match_id and l.place = c.p1 left join ch lo on lo.match_id = c.match_id and lo.place = c.o1),
sq1 as (select *, lag(club_id) over w as pc, lag(last_half) over w as ph, lag(last_t) over w as pt, lead(first_half) over w as nh, lead(first_t) over w as nt from sq0 window w as (partition by match_id order by chain_id)),
sq2 as (select *, case when first_type = 'throw_in' and first_club = club_id then 'restart' when ph is null or ph <> first_half then 'half_start' when first_t - pt > 600 then 'gap' when pc <> club_id then 'regain' else 'unknown' end as start_cause,
  case when last_own_type = 'shot' then 'shot' when nh is null then 'stream_end' when nh <> last_half then 'half_end' when nt - last_t > 600 then 'gap' else 'turnover' end as end_cause from sq1),
pts as (select match_id, chain_id, place, 0 as side, x as px, y as py from ch where club_id = chain_club union all select match_id, chain_id, place, 1, end_x, end_y from ch where club_id = chain_club and end_x is not null),
paths as (select match_id, chain_id, arg_min(px, place * 2 + side) as fx, arg_min(py, place * 2 + side) as fy, arg_max(px, place * 2 + side) as lx, arg_max(py, place * 2 + side) as ly, coalesce(sum(step), 0) as path, bool_or(side = 0 and {_box('px', 'py')}) as box
  from (select *, sqrt((px - lag(px) over w) * (px - lag(px) over w) + (py - lag(py) over w) * (py - lag(py) over w)) as step from pts window w as (partition by match_id, chain_id order by place, side)) group by all),
sq3 as (select s.*, fx, fy, path, box, {_goal('fx', 'fy')} as sd, {_goal('fx', 'fy')} - {_goal('lx', 'ly')} as prog, case when path > 0 then ({_goal('fx', 'fy')} - {_goal('lx', 'ly')}) / path end as dir, coalesce(last_own_type = 'shot', false) as shot from sq2 s left join paths p using (match_id, chain_id)),
sq as (select *, case when start_cause = 'regain' and sd <= 4000 then 'high_turnover' when start_cause = 'regain' and fx < 7000 and prog >= 18 * 91.44 and dir >= 0.75 then 'counter_attack' when start_cause <> 'restart' and fx >= 4250 and fx < 5250 and dir >= 0.5 and (shot or box) then 'direct_attack' when start_cause <> 'restart' and n_own_passes >= 10 and (shot or box) then 'build_up' else 'unclassified' end as chain_type from sq3)
"""


@query("chain_causes", "select match_id, chain_id, start_cause, end_cause from sq", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.causes(chains.chain_table(ch), GAP).select("match_id", "chain_id", "start_cause", "end_cause")


@query("chain_types", "select match_id, chain_id, chain_type, round(path, 3) as path_length, round(prog, 3) as progression, round(dir, 4) as directness, shot as ends_in_shot from sq", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    rows = sequences.classified(ch, max_gap=GAP)
    return rows.select("match_id", "chain_id", "chain_type", F.round("path_length", 3).alias("path_length"), F.round("progression", 3).alias("progression"), F.round("directness", 4).alias("directness"), "ends_in_shot")


@query("chain_type_counts", "select v.chain_type, count(sq.chain_id) as n_chains from (values ('high_turnover'), ('counter_attack'), ('direct_attack'), ('build_up'), ('set_piece'), ('unclassified')) v(chain_type) left join sq on sq.chain_type = v.chain_type group by all", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.type_counts(sequences.classified(ch, max_gap=GAP))


@query("chain_start_causes", "select v.c as start_cause, count(sq.chain_id) as n_chains from (values ('regain'), ('restart'), ('gap'), ('half_start'), ('unknown')) v(c) left join sq on sq.start_cause = v.c group by all", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.start_cause_counts(sequences.causes(chains.chain_table(ch), GAP))


@query("chain_end_causes", "select v.c as end_cause, count(sq.chain_id) as n_chains from (values ('shot'), ('turnover'), ('gap'), ('half_end'), ('stream_end')) v(c) left join sq on sq.end_cause = v.c group by all", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.end_cause_counts(sequences.causes(chains.chain_table(ch), GAP))


@query("chain_conversion", "select v.chain_type, count(*) filter (shot) as shot_ending, count(sq.chain_id) as n_chains, round(case when count(sq.chain_id) >= 10 then count(*) filter (shot) / count(sq.chain_id) end, 4) as conversion from (values ('high_turnover'), ('counter_attack'), ('direct_attack'), ('build_up'), ('set_piece'), ('unclassified')) v(chain_type) left join sq on sq.chain_type = v.chain_type group by all", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.conversion(sequences.classified(ch, max_gap=GAP))


@query("chain_threshold_sweep", "select 'published' as variant, chain_type, count(*) as n_chains from sq group by all union all select 'no_high_turnover', case when start_cause = 'regain' and fx < 7000 and prog >= 18 * 91.44 and dir >= 0.75 then 'counter_attack' when start_cause <> 'restart' and fx >= 4250 and fx < 5250 and dir >= 0.5 and (shot or box) then 'direct_attack' when start_cause <> 'restart' and n_own_passes >= 10 and (shot or box) then 'build_up' else 'unclassified' end as ct, count(*) from sq group by ct", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.threshold_sweep(ch, {"published": sequences.Thresholds(), "no_high_turnover": sequences.Thresholds(high_turnover_distance=-1.0)}, max_gap=GAP)


@query("high_turnovers", "select match_id, count(*) as n_chains, count(*) filter (shot) as shot_ending, round(case when count(*) >= 10 then count(*) filter (shot) / count(*) end, 4) as shot_ending_rate from sq where chain_type = 'high_turnover' group by all", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.attack_report(sequences.classified(ch, max_gap=GAP), "high_turnover")


@query("counter_attacks", "select match_id, count(*) as n_chains, count(*) filter (shot) as shot_ending, round(case when count(*) >= 10 then count(*) filter (shot) / count(*) end, 4) as shot_ending_rate from sq where chain_type = 'counter_attack' group by all", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.attack_report(sequences.classified(ch, max_gap=GAP), "counter_attack")


@query("turnover_sites", "select sq.match_id, sq.chain_id, sq.club_id, 10500 - c.x as lost_x, 6800 - c.y as lost_y from sq join ch c on c.match_id = sq.match_id and c.place = sq.o0 where start_cause = 'regain'", _CHAINS + _SEQ)
def _(ch: DataFrame) -> DataFrame:
    return sequences.turnover_sites(sequences.causes(chains.chain_table(ch), GAP))


@query("tier_one_sheet")
def _(ch: DataFrame) -> DataFrame:
    return players.tier_one(ch, models.shots)


@query("contest_events", "select match_id, type, count(*) as n from ch where type in ('tackle','block','header') group by all")
def _(ch: DataFrame) -> DataFrame:
    return chains.contest_events(ch).groupBy("match_id", "type").agg(F.count("*").alias("n"))


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, ex, ey = (F.col(c) for c in ("x", "y", "end_x", "end_y"))
    ex_t, ey_t = G.turned(x, y)
    zone = G.Grid().zone(x, y)
    return match_events(spark, sf_dir).select(
        "event_id", G.third(x).alias("third"), G.in_final_third(x).alias("final_third"), G.in_box(x, y).alias("in_box"), G.is_plausible(x, y).alias("plausible"), F.round(G.goal_distance(x, y), 3).alias("goal_distance"),
        F.round(G.goal_angle(x, y), 5).alias("goal_angle"), G.direction(x, y, ex, ey).alias("direction"), F.round(G.progression(x, y, ex, ey), 3).alias("progression"), F.round(G.nearest(x, y, F.col("opponents")), 3).alias("nearest"),
        G.under_pressure(x, y, F.col("opponents")).alias("pressed"), G.in_lane(x, y, F.col("opponents")).alias("lane"), F.round(G.corner_flag_distance(x, y), 3).alias("flag"), G.touchline_distance(y).alias("touchline"), ex_t.alias("turned_x"), ey_t.alias("turned_y"),
        zone.alias("zone"), G.Grid().mirrored(zone).alias("mirrored"),
        G.length_bucket(G.distance(x, y, ex, ey), teams.LENGTHS).alias("length_bucket"),
    )


QUERIES["geometry"] = _geometry
ORACLE_SQL["geometry"] = f"""with {_EVENTS} select event_id, case when x < 3500 then 'defensive' when x < 7000 then 'middle' else 'final' end as third, x >= 7000 as final_third, {_box('x', 'y')} as in_box, x between -300 and 10800 and y between -300 and 7100 as plausible,
 round({_goal('x', 'y')}, 3) as goal_distance, round(case when x >= 10500 then 0 else abs(atan2(3766 - y, 10500 - x) - atan2(3034 - y, 10500 - x)) end, 5) as goal_angle, case when end_x is not null then {_direction()} end as direction, round({_GAIN}, 3) as progression,
 round((select min(sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y))) from opp o where o.event_id = s.event_id), 3) as nearest, (select min(sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y))) from opp o where o.event_id = s.event_id) <= 500 as pressed, cast({_LANE} as int) as lane,
 round(sqrt((10500 - x) * (10500 - x) + least(y * y, (6800 - y) * (6800 - y))), 3) as flag, least(y, 6800 - y) as touchline, 10500 - x as turned_x, 6800 - y as turned_y, cast({_ZONE('x', 'y')} as int) as zone,
 cast((11 - greatest(0, least(11, trunc(y / 6800 * 12)))) * 16 + greatest(0, least(15, trunc(x / 10500 * 16))) as int) as mirrored,
 case when sqrt((end_x - x) * (end_x - x) + (end_y - y) * (end_y - y)) < 1500 then 'short' when sqrt((end_x - x) * (end_x - x) + (end_y - y) * (end_y - y)) < 3000 then 'medium' when end_x is not null then 'long' end as length_bucket from ev s"""

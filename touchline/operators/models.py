"""Expected goals, expected threat, momentum, percentiles."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators.chains import ORDER
from touchline.sources.matches import MOVE_TYPES


@dataclass(frozen=True)
class Coefficients:
    """Terms of the logistic shot model."""

    intercept: float
    angle: float
    distance: float
    x: float
    c: float
    x2: float
    c2: float
    angle_x: float
    header: float
    set_piece: float
    lane: float


# The published open-play fit with its header, set-piece and defender terms.
PUBLISHED = Coefficients(0.5103, 0.6338, -0.2798, 0.1243, -0.03, 0.0014, 0.0041, -0.1251, -1.16, -0.3, -0.25)
PENALTY_XG, NEUTRAL_DEFENDERS, NEAREST_X_M = 0.8, 1, 0.5


def logit(x_m: Column, c_m: Column, header: Column, set_piece: Column, lane: Column, b: Coefficients = PUBLISHED) -> Column:
    angle, distance = G.shot_angle(x_m, c_m), F.sqrt(x_m * x_m + c_m * c_m)
    extra = F.greatest(F.lit(0), F.coalesce(lane, F.lit(NEUTRAL_DEFENDERS)) - NEUTRAL_DEFENDERS)
    return (
        b.intercept + b.angle * angle + b.distance * distance + b.x * x_m + b.c * c_m + b.x2 * x_m * x_m + b.c2 * c_m * c_m + b.angle_x * angle * x_m
        + b.header * header.cast("double") + b.set_piece * set_piece.cast("double") + b.lane * extra
    )


def _is_header(events: DataFrame) -> Column:
    return F.col("is_header") if "is_header" in events.columns else F.lit(None).cast("boolean")


def _seen(header: Column, pitch: G.Pitch) -> dict[str, Column]:
    """What logit() reads of a shot alone, whatever came before it."""
    return {
        "x_m": F.greatest(F.lit(NEAREST_X_M), (pitch.length - F.col("x")) / 100),
        "c_m": F.abs(F.col("y") - pitch.width / 2) / 100,
        "header": F.coalesce(header, F.lit(False)),
        "lane": G.in_lane(F.col("x"), F.col("y"), F.col("opponents"), pitch),
    }


def shot_xg(events: DataFrame, set_piece: bool, pitch: G.Pitch = G.FIFA, b: Coefficients = PUBLISHED) -> Column:
    """The xg of shots() for a known origin: of the event alone, so that it can stand before chains are built."""
    seen = _seen(_is_header(events), pitch)
    return G.logistic(logit(seen["x_m"], seen["c_m"], seen["header"], F.lit(set_piece), seen["lane"], b))


def shots(chained: DataFrame, pitch: G.Pitch = G.FIFA, source_labels_set_pieces: bool = False, b: Coefficients = PUBLISHED) -> DataFrame:
    """Shots with features, xg and `defaulted`: the features that had to be assumed.

    A set-piece origin is true after a throw-in of the same chain (a header: after a cross); else it is false only where the source labels set
    pieces, and unknown, counted as false, where it does not. is_header is read if there is such a column.
    """
    order = Window.partitionBy("match_id").orderBy(*ORDER)
    rows = chained.withColumn("_before", F.lag(F.struct("type", "chain_id")).over(order)).where("type = 'shot'")
    header = _is_header(chained)
    raw = (pitch.length - F.col("x")) / 100
    seen = _seen(header, pitch)
    same = F.col("_before.chain_id") == F.col("chain_id")
    restart = (F.col("_before.type") == "throw_in") | (F.coalesce(header, F.lit(False)) & (F.col("_before.type") == "cross"))
    otherwise = F.lit(False) if source_labels_set_pieces else F.lit(None).cast("boolean")
    origin = F.when(F.col("_before").isNull(), F.lit(None).cast("boolean")).when(~same, otherwise).when(restart, True).otherwise(otherwise)
    rows = rows.withColumns(
        {
            "x_m": seen["x_m"],
            "c_m": seen["c_m"],
            "header": seen["header"],
            "set_piece": F.coalesce(origin, F.lit(False)),
            "origin": origin,
            "lane": seen["lane"],
        }
    )
    missing = [F.when(header.isNull(), "header"), F.when(origin.isNull(), "set_piece"), F.when(F.col("lane").isNull(), "lane"), F.when(raw < NEAREST_X_M, "x_m")]
    rows = rows.withColumn("defaulted", F.array_compact(F.array(*missing)))
    return rows.withColumn("xg", G.logistic(logit(*(F.col(c) for c in ("x_m", "c_m", "header", "set_piece", "lane")), b))).drop("_before")


def location_xg(x: Column, y: Column, pitch: G.Pitch = G.FIFA, b: Coefficients = PUBLISHED) -> Column:
    """xG of a bare place: no header, no set piece, nothing known of defenders."""
    x_m = F.greatest(F.lit(NEAREST_X_M), (pitch.length - x) / 100)
    return G.logistic(logit(x_m, F.abs(y - pitch.width / 2) / 100, F.lit(False), F.lit(False), F.lit(None).cast("int"), b))


def shot_sheet(chained: DataFrame) -> DataFrame:
    """Shots and xG per match and player."""
    return shots(chained).where("player_id is not null").groupBy("match_id", "player_id").agg(F.count("*").alias("shots"), F.round(F.sum("xg"), 4).alias("xg"))


def midrank(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds percentile: the mid rank among the group's values from 0 to 100; 50 for a group of one."""
    ranked = Window.partitionBy(*by).orderBy(value)
    ties, n = F.count("*").over(Window.partitionBy(*by, value)), F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("percentile", F.when(n == 1, 50.0).otherwise(100 * (F.rank().over(ranked) - 1 + (ties - 1) / 2) / (n - 1)))


@dataclass(frozen=True)
class Threat:
    """A fitted surface of expected threat, by zone, and how the fit went."""

    grid: G.Grid
    value: np.ndarray
    shot_share: np.ndarray
    shot_value: np.ndarray
    iterations: int
    converged: bool
    shrunk: int


def zone_counts(chained: DataFrame, grid: G.Grid = G.Grid()) -> DataFrame:  # noqa: B008
    """Per zone: shots, attempted moves of known outcome, and completed ones with a known end."""
    zone = grid.zone(F.col("x"), F.col("y")).alias("zone")
    move = F.col("type").isin(MOVE_TYPES) & (F.col("outcome") != "unknown")
    done = move & (F.col("outcome") == "complete") & F.col("end_x").isNotNull()
    rows = chained.where((F.col("type") == "shot") | F.col("type").isin(MOVE_TYPES))
    return rows.groupBy(zone).agg(F.count(F.when(F.col("type") == "shot", 1)).alias("shots"), F.count(F.when(move, 1)).alias("moves"), F.count(F.when(done, 1)).alias("completed"))


def transitions(chained: DataFrame, grid: G.Grid = G.Grid()) -> DataFrame:  # noqa: B008
    """How many completed moves lead from zone to zone."""
    done = F.col("type").isin(MOVE_TYPES) & (F.col("outcome") == "complete") & F.col("end_x").isNotNull()
    return chained.where(done).groupBy(grid.zone(F.col("x"), F.col("y")).alias("zone"), grid.zone(F.col("end_x"), F.col("end_y")).alias("to_zone")).agg(F.count("*").alias("n"))


def fit_threat(chained: DataFrame, grid: G.Grid | None = None, failures_absorb: bool = True, tolerance: float = 1e-5, support: int = 20, rounds: int = 500) -> Threat:
    """Value iteration over the zones: shoot for the place's xG, or move on. Only counts of at most grid zones squared come to the driver.

    A zone with fewer actions than `support` is shrunk towards the share of shots over all, in proportion. Moves that fail absorb (the
    denominators are attempts) or are left out (completed moves).
    """
    grid = grid or G.Grid()
    n = grid.nx * grid.ny
    shot, move, done, matrix = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, n))
    known = F.col("type").isin(MOVE_TYPES) & (F.col("outcome") != "unknown")
    ended = known & (F.col("outcome") == "complete") & F.col("end_x").isNotNull()
    to = F.when(ended, grid.zone(F.col("end_x"), F.col("end_y")))
    rows = chained.where((F.col("type") == "shot") | known)  # one pass: zone_counts() and transitions() together
    for r in rows.groupBy((F.col("type") == "shot").alias("shot"), grid.zone(F.col("x"), F.col("y")).alias("zone"), to.alias("to_zone")).agg(F.count("*").alias("n")).collect():
        if r.shot:
            shot[r.zone] += r.n
            continue
        move[r.zone] += r.n
        if r.to_zone is not None:
            done[r.zone] += r.n
            matrix[r.zone, r.to_zone] += r.n
    actions = shot + move
    overall = shot.sum() / actions.sum() if actions.sum() else 0.0
    trust = np.minimum(actions / support, 1.0)
    own = np.divide(shot, actions, out=np.zeros(n), where=actions > 0)
    share = np.where(actions > 0, trust * own + (1 - trust) * overall, overall)
    denominator = move if failures_absorb else done
    matrix = np.divide(matrix, denominator[:, None], out=np.zeros((n, n)), where=denominator[:, None] > 0)
    zones = chained.sparkSession.range(n)
    x, y = grid.centre(F.col("id"))
    worth = np.array([r[0] for r in zones.orderBy("id").select(location_xg(x, y, grid.pitch)).collect()])
    value, step = np.zeros(n), 0
    converged = False
    while step < rounds and not converged:
        new = share * worth + (1 - share) * (matrix @ value)
        converged = bool(np.abs(new - value).max() < tolerance)
        value, step = new, step + 1
    return Threat(grid, value, share, worth, step, converged, int(((actions > 0) & (actions < support)).sum()))


def credit_moves(chained: DataFrame, threat: Threat) -> DataFrame:
    """Each move with the threat where it began; where it ended and the difference, if it is complete and its end known."""
    surface = F.array(*map(F.lit, threat.value.tolist()))
    at = lambda x, y: F.get(surface, threat.grid.zone(F.col(x), F.col(y)))
    rows = chained.where(F.col("type").isin(MOVE_TYPES))
    done = (F.col("outcome") == "complete") & F.col("end_x").isNotNull()
    rows = rows.withColumns({"xt_start": at("x", "y"), "completed": done, "xt_end": F.when(done, at("end_x", "end_y"))})
    return rows.select("match_id", "half", "event_id", "frame_idx", "t", "player_id", "club_id", "completed", "xt_start", "xt_end", (F.col("xt_end") - F.col("xt_start")).alias("delta"))


def threat_by_player(credits: DataFrame) -> DataFrame:
    """Threat added per match and player; failed moves cost the threat where they began in the risk-adjusted total."""
    failed = F.col("delta").isNull()
    return credits.where("player_id is not null").groupBy("match_id", "player_id", "club_id").agg(
        F.round(F.coalesce(F.sum("delta"), F.lit(0.0)), 4).alias("xt_total"),
        F.round(F.sum(F.coalesce("delta", -F.col("xt_start"))), 4).alias("xt_risk_adjusted"),
        F.round(F.coalesce(F.sum(F.when(failed, F.col("xt_start"))), F.lit(0.0)), 4).alias("failed_xt_at_start"),
        F.count("delta").alias("n_rated"),
        F.count(F.when(failed, 1)).alias("n_failed"),
    )


def top_actions(credits: DataFrame, n: int = 5, risk_adjusted: bool = True) -> DataFrame:
    """The n best moves of each match; failed ones count against their start, or come last."""
    worth = F.coalesce("delta", -F.col("xt_start") if risk_adjusted else F.lit(-math.inf))
    best = Window.partitionBy("match_id").orderBy(F.col("worth").desc(), "half", "frame_idx", "event_id")
    return credits.withColumn("worth", worth).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def momentum(credits: DataFrame, bin_s: float = 60.0, half_life_min: float = 1.0, cap: float = 0.1, floor: float = 1e-6) -> DataFrame:
    """Per match, half and bin, for either club: its best capped threat of recent bins, exponentially weighted, less the opponent's.

    Bins run without holes from a half's first to its last. Weights under the floor are left out, which bounds how far back a bin looks.
    """
    capped = F.least(F.lit(cap), F.greatest(F.lit(0.0), F.col("delta")))
    bins = credits.where("delta is not null").withColumns({"bin": F.floor(F.col("t") / bin_s), "value": capped})
    best = bins.groupBy("match_id", "half", "bin").agg(*(F.coalesce(F.max(F.when(F.col("club_id") == c, F.col("value"))), F.lit(0.0)).alias(f"v{c}") for c in (0, 1)))
    spine = bins.groupBy("match_id", "half").agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    dense = spine.join(best, ["match_id", "half", "bin"], "left").fillna(0.0, ["v0", "v1"])
    decay = math.log(2) / (half_life_min * 60 / bin_s)
    reach = max(k for k in range(10_000) if math.exp(-decay * k) >= floor)
    recent = Window.partitionBy("match_id", "half").orderBy("bin").rowsBetween(-reach, 0)
    window = dense.select("match_id", "half", "bin", "v0", "v1", *(F.collect_list(f"v{c}").over(recent).alias(f"w{c}") for c in (0, 1)))
    weight = lambda i, n: F.exp(F.lit(-decay) * (n - 1 - i))
    total = lambda c: F.aggregate(F.transform(f"w{c}", lambda v, i: v * weight(i, F.size(f"w{c}"))), F.lit(0.0), lambda s, v: s + v)
    weights = F.aggregate(F.transform("w0", lambda _, i: weight(i, F.size("w0"))), F.lit(0.0), lambda s, v: s + v)
    smooth = window.select("match_id", "half", "bin", "v0", "v1", (total(0) / weights).alias("s0"), (total(1) / weights).alias("s1"), weights.alias("weight_sum"))
    sides = F.inline(F.array(*(F.struct(F.lit(a).cast("long").alias("club_id"), (F.col(f"s{a}") - F.col(f"s{b}")).alias("value"), F.col(f"v{a}").alias("raw_club"), F.col(f"v{b}").alias("raw_opponent")) for a, b in ((0, 1), (1, 0)))))
    return smooth.select("match_id", "half", (F.col("bin") * bin_s / 60).alias("minute"), "weight_sum", sides)


def fit_fingerprint(grid: G.Grid, **settings: object) -> str:
    """A hash of everything a fit depends on, to name a stored fit by."""
    return hashlib.sha256(json.dumps({"grid": asdict(grid), **settings}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

"""Duels, take-ons, recoveries and turnovers. Input: chained events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators.chains import backwards, chain_table, is_possession, possession_changes
from touchline.sources.matches import MAX_GAP

TAKE_ON_RADIUS, AERIAL_WINDOW = 300.0, 1.0


def _around(events: DataFrame, max_gap: float) -> DataFrame:
    """Adds held (the last possession event before, while live) and winner (club of the next one, while live)."""
    half = Window.partitionBy("match_id", "half").orderBy("frame_idx", "event_id")
    event = F.when(is_possession(), F.struct("t", "club_id", "player_id"))
    before = F.last(event, ignorenulls=True).over(half.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(event, ignorenulls=True).over(backwards("match_id", "half"))
    events = events.withColumns({"_before": before, "_after": after})
    return events.withColumns(
        {
            "held": F.when(F.col("t") - F.col("_before.t") <= max_gap, F.col("_before")),
            "winner_club": F.when(F.col("_after.t") - F.col("t") <= max_gap, F.col("_after.club_id")),
        }
    ).drop("_before", "_after")


def ground_duels(events: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """Tackles and blocks against the club in possession; won by the club that has the ball next, null if play has stopped."""
    rows = _around(events, max_gap).where(F.col("type").isin("tackle", "block") & (F.col("held.club_id") != F.col("club_id")))
    return rows.select(
        "match_id", "half", "t", F.lit("ground").alias("kind"), "event_id", F.lit(None).cast("long").alias("other_event_id"), F.col("club_id").alias("a_club"), F.col("player_id").alias("a_player"),
        F.col("held.club_id").alias("b_club"), F.col("held.player_id").alias("b_player"), "winner_club",
    )


def aerial_duels(events: DataFrame, window: float = AERIAL_WINDOW, max_gap: float = MAX_GAP) -> DataFrame:
    """Headers of opposing clubs within the window, each used once, paired greedily in stream order per match and half."""
    headers = _around(events, max_gap).where("type = 'header'").select("match_id", "half", "frame_idx", "event_id", "t", "club_id", "player_id", "winner_club")
    schema = "match_id long, half int, t double, kind string, event_id long, other_event_id long, a_club long, a_player long, b_club long, b_player long, winner_club long"

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_idx", "event_id"], ignore_index=True)
        t, club, used, out = rows["t"].to_numpy(), rows["club_id"].to_numpy(), set(), []
        for i in range(len(rows)):
            if i in used:
                continue
            for j in range(i + 1, len(rows)):
                if j in used:
                    continue
                if t[j] - t[i] > window:
                    break
                if club[j] != club[i]:
                    used |= {i, j}
                    a, b = rows.iloc[i], rows.iloc[j]
                    out.append((a.match_id, a.half, a.t, "aerial", a.event_id, b.event_id, a.club_id, a.player_id, b.club_id, b.player_id, b.winner_club))
                    break
        found = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
        return found.astype({c: "Int64" for c in ("other_event_id", "a_player", "b_player", "winner_club")})

    return headers.groupBy("match_id", "half").applyInPandas(pair, schema)


def duels(events: DataFrame, window: float = AERIAL_WINDOW, max_gap: float = MAX_GAP) -> DataFrame:
    return aerial_duels(events, window, max_gap).unionByName(ground_duels(events, max_gap))


def aerial_window_sweep(events: DataFrame, windows: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0), max_gap: float = MAX_GAP) -> DataFrame:
    """How many aerial duels each window finds."""
    out = None
    for w in windows:
        found = aerial_duels(events, w, max_gap).agg(F.lit(w).alias("window_s"), F.count("*").alias("n_duels"))
        out = found if out is None else out.unionAll(found)
    return out


def by_participant(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Won, resolved and unresolved duels of each known participant, by kind."""
    keys = keys or ["match_id", "half"]
    sides = found.select(*keys, "kind", "winner_club", F.inline(F.array(F.struct(F.col("a_player").alias("player_id"), F.col("a_club").alias("club_id")), F.struct(F.col("b_player").alias("player_id"), F.col("b_club").alias("club_id")))))
    columns = []
    for kind in ("ground", "aerial"):
        own = F.col("kind") == kind
        columns += [
            F.count(F.when(own & F.col("winner_club").isNotNull(), 1)).alias(f"{kind}_duels"),
            F.count(F.when(own & (F.col("winner_club") == F.col("club_id")), 1)).alias(f"{kind}_duels_won"),
            F.count(F.when(own & F.col("winner_club").isNull(), 1)).alias(f"{kind}_duels_unresolved"),
        ]
    return sides.where("player_id is not null").groupBy(*keys, "player_id", "club_id").agg(*columns)


def duels_by_player(events: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    return by_participant(duels(events, max_gap=max_gap))


def take_ons(events: DataFrame, radius: float = TAKE_ON_RADIUS) -> DataFrame:
    """Carries past at least one opponent who stood within the radius of the start, between start and end."""
    passed = F.filter("opponents", lambda o: (o["x"] > F.col("x")) & (o["x"] < F.col("end_x")) & (G.distance(F.col("x"), F.col("y"), o["x"], o["y"]) <= radius))
    rows = events.where("type = 'carry' and end_x is not null").withColumn("beaten_opponents", F.size(passed)).where("beaten_opponents > 0")
    return rows.select("match_id", "half", "event_id", "player_id", "club_id", "t", (F.col("outcome") == "complete").alias("completed"), "beaten_opponents")


def take_ons_by_player(events: DataFrame, radius: float = TAKE_ON_RADIUS) -> DataFrame:
    rows = take_ons(events, radius).where("player_id is not null")
    return rows.groupBy("match_id", "half", "player_id", "club_id").agg(F.count("*").alias("take_ons"), F.count(F.when(F.col("completed"), 1)).alias("take_ons_completed"))


def take_on_rate(events: DataFrame, radius: float = TAKE_ON_RADIUS) -> DataFrame:
    """Take-ons per carry and match; null without carries."""
    found = take_ons(events, radius).groupBy("match_id").agg(F.count("*").alias("n"))
    carries = events.groupBy("match_id").agg(F.count(F.when(F.col("type") == "carry", 1)).alias("carries"))
    rate = F.round(F.coalesce("n", F.lit(0)) / F.when(F.col("carries") > 0, F.col("carries")), 4)
    return carries.join(found, "match_id", "left").select("match_id", F.coalesce("n", F.lit(0)).alias("take_ons"), "carries", rate.alias("take_on_rate"))


def ball_events(chained: DataFrame, pitch: G.Pitch = G.FIFA, max_gap: float = MAX_GAP, anchor: str = "end") -> DataFrame:
    """For each live possession change, the loser's last own event (turnover, at its end or start) and the gainer's first (recovery)."""
    if anchor not in ("end", "start"):
        raise ValueError(f"anchor must be end or start, not {anchor!r}")
    changes = possession_changes(chain_table(chained), max_gap)
    lost, won = F.col("last_own"), F.col("gain.first_own")
    at = (F.coalesce(lost["end_x"], lost["x"]), F.coalesce(lost["end_y"], lost["y"])) if anchor == "end" else (lost["x"], lost["y"])
    part = lambda kind, e, x, y: F.struct(F.lit(kind).alias("kind"), e["half"].alias("half"), e["event_id"].alias("event_id"), e["player_id"].alias("player_id"), e["club_id"].alias("club_id"), e["t"].alias("t"), x.alias("x"), y.alias("y"))
    rows = changes.select("match_id", F.inline(F.array(part("turnover", lost, *at), part("recovery", won, won["x"], won["y"]))))
    return rows.withColumn("third", G.third(F.col("x"), pitch))


def balls_by_player(chained: DataFrame, pitch: G.Pitch = G.FIFA, max_gap: float = MAX_GAP) -> DataFrame:
    rows = ball_events(chained, pitch, max_gap).where("player_id is not null")
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(name) for k, name in (("recovery", "recoveries"), ("turnover", "turnovers"))]
    return rows.groupBy("match_id", "half", "player_id", "club_id").agg(*kinds)


def counts_by_third(balls: DataFrame) -> DataFrame:
    """Recoveries and turnovers per match and kind in the three thirds; a third without any counts 0."""
    thirds = [F.count(F.when(F.col("third") == x, 1)).alias(x) for x in ("defensive", "middle", "final")]
    return balls.groupBy("match_id", "kind").agg(*thirds)


def take_on_null_rates(events: DataFrame, trials: int = 20, seed: int = 0, radius: float = TAKE_ON_RADIUS, pitch: G.Pitch = G.FIFA) -> DataFrame:
    """Per match, take-ons per carry as observed and with the opponents dealt anew among carries: among all, and within strata of start third and gain.

    Opponent sets are dealt by hashed order, so each trial is one shuffle of the stratum and the same again for a seed.
    """
    carries = events.where("type = 'carry'")
    gain = F.col("end_x") - F.col("x")
    band = F.when(gain <= 0, 0).when(gain < 300, 1).when(gain < 914, 2).otherwise(3)
    whole = carries.where("end_x is not null").select("match_id", "event_id", "x", "y", "end_x", "opponents", F.concat_ws(":", G.third(F.col("x"), pitch), band).alias("matched"), F.lit("all").alias("unstratified"))
    n = carries.groupBy("match_id").agg(F.count("*").alias("n"))
    out = n.join(take_on_rate(events, radius).select("match_id", F.col("take_on_rate").alias("observed")), "match_id")
    for name in ("unstratified", "matched"):
        each = whole.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
        own = Window.partitionBy("match_id", name, "trial").orderBy("event_id")
        dealt = Window.partitionBy("match_id", name, "trial").orderBy(F.xxhash64(F.lit(seed), F.lit(name), "trial", "event_id"), "event_id")
        left = each.select("match_id", name, "trial", "x", "y", "end_x", F.row_number().over(own).alias("place"))
        right = each.select("match_id", name, "trial", "opponents", F.row_number().over(dealt).alias("place"))
        both = left.join(right, ["match_id", name, "trial", "place"])
        beaten = F.exists("opponents", lambda o: (o["x"] > F.col("x")) & (o["x"] < F.col("end_x")) & (G.distance(F.col("x"), F.col("y"), o["x"], o["y"]) <= radius))
        hits = both.groupBy("match_id").agg(F.count(F.when(beaten, 1)).alias(f"{name}_hits"))
        out = out.join(hits, "match_id", "left").withColumn(name, F.round(F.coalesce(f"{name}_hits", F.lit(0)) / trials / F.col("n"), 6)).drop(f"{name}_hits")
    return out.select("match_id", "observed", "unstratified", "matched")



"""Possession chains, inferred outcomes and possession changes, without recursion.

Every function partitions by match_id: halves are per match and frames per half, so matches never interleave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.sources.matches import CONTEST_TYPES, MAX_GAP, POSSESSION_TYPES

ORDER = ("half", "frame_idx", "event_id")
_INFERRED = ["pass", "cross", "carry", "throw_in"]


def backwards(*keys: str) -> WindowSpec:
    """All later events, the nearest last. A frame that grows from the end: one that shrinks towards it is read anew for every row."""
    return Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in ORDER)).rowsBetween(Window.unboundedPreceding, -1)


def is_contest() -> Column:
    return F.col("type").isin(CONTEST_TYPES)


def is_possession() -> Column:
    return F.col("type").isin(POSSESSION_TYPES)


def with_chains(events: DataFrame, max_gap: float = MAX_GAP, keep_replays: bool = False) -> DataFrame:
    """Adds chain_id (from 0 per match), chain_club, gap_split, outcome, outcome_source and receiver_id; replays go first.

    A chain begins with a match, a half, after more than max_gap seconds, or with another club's event that is no contest. Contests never
    change whose chain it is unless they begin a segment, so the club before an event is that of the last event that either is no
    contest or began a segment: a running value, no recursion.
    """
    if not keep_replays:
        events = events.where(~F.col("replay"))
    order = Window.partitionBy("match_id").orderBy(*ORDER)
    half_before, t_before = F.lag("half").over(order), F.lag("t").over(order)
    late = (half_before == F.col("half")) & (F.col("t") - t_before > max_gap)
    cut = half_before.isNull() | (half_before != F.col("half")) | late
    events = events.withColumns({"_cut": cut, "gap_split": F.coalesce(late, F.lit(False))})
    events = events.withColumn("_segment", F.sum(F.col("_cut").cast("int")).over(order))
    within = Window.partitionBy("match_id", "_segment").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    sets_club = F.col("_cut") | ~is_contest()
    holder = F.last(F.when(sets_club, F.col("club_id")), ignorenulls=True).over(within)
    starts = F.col("_cut") | ((holder != F.col("club_id")) & ~is_contest())
    events = events.withColumn("_starts", starts)
    events = events.withColumn("chain_id", (F.sum(F.col("_starts").cast("int")).over(order) - 1).cast("long"))
    events = events.withColumn("chain_club", F.first(F.when(F.col("_starts"), F.col("club_id")), ignorenulls=True).over(Window.partitionBy("match_id", "chain_id")))
    return with_outcomes(events, max_gap).drop("_cut", "_segment", "_starts")


def with_outcomes(events: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """Outcomes of unlabelled passes, crosses, carries and throw-ins from the next possession-defining event of the match.

    complete for the same club, incomplete for the other, unknown if there is none, in another half or too late. The receiver is the next
    actor of the same club if it is another player; a carry has none.
    """
    following = F.last(F.when(is_possession(), F.struct("half", "t", "club_id", "player_id")), ignorenulls=True).over(backwards("match_id"))
    events = events.withColumn("_next", following)
    infer = (F.col("outcome_source") != "labelled") & F.col("type").isin(_INFERRED)
    live = F.coalesce((F.col("_next.half") == F.col("half")) & (F.col("_next.t") - F.col("t") <= max_gap), F.lit(False))
    same = F.col("_next.club_id") == F.col("club_id")
    outcome = F.when(~live, "unknown").when(same, "complete").otherwise("incomplete")
    other = F.col("player_id").isNull() | (F.col("_next.player_id") != F.col("player_id"))
    receiver = F.when(infer & live & same & (F.col("type") != "carry") & other, F.col("_next.player_id"))
    return events.withColumns(
        {
            "outcome": F.when(infer, outcome).otherwise(F.col("outcome")),
            "outcome_source": F.when(infer, "inferred").otherwise(F.col("outcome_source")),
            "receiver_id": receiver,
        }
    ).drop("_next")


def chain_table(chained: DataFrame) -> DataFrame:
    """One row per chain: club, first and last event of all, and what its own club did in it."""
    own = F.col("club_id") == F.col("chain_club")
    place = F.struct(*ORDER)
    event = F.struct("event_id", "type", "t", "half", "club_id", "player_id", "x", "y", "end_x", "end_y")
    return chained.groupBy("match_id", "chain_id").agg(
        F.first("chain_club").alias("club_id"),
        F.count("*").alias("n_events"),
        F.min_by(event, place).alias("first"),
        F.max_by(event, place).alias("last"),
        F.min_by(F.when(own, event), F.when(own, place)).alias("first_own"),
        F.max_by(F.when(own, event), F.when(own, place)).alias("last_own"),
        F.count(F.when(own, 1)).alias("n_own"),
        F.count(F.when(own & F.col("type").isin("pass", "cross"), 1)).alias("n_own_passes"),
        F.coalesce(F.bool_or(own & is_possession()), F.lit(False)).alias("held"),
    )


def possession_changes(chains: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """Adjacent chains of different clubs, in one half and close in time, that both held the ball.

    Adjacent means in the list of all chains, so nothing is filtered before the lead.
    """
    order = Window.partitionBy("match_id").orderBy("chain_id")
    gained = F.lead(F.struct("chain_id", "club_id", "first", "first_own", "held")).over(order)
    pairs = chains.withColumn("gain", gained)
    live = (F.col("gain.first.half") == F.col("last.half")) & (F.col("gain.first.t") - F.col("last.t") <= max_gap)
    return pairs.where((F.col("gain.club_id") != F.col("club_id")) & live & F.col("held") & F.col("gain.held"))


def chain_summary(chained: DataFrame) -> DataFrame:
    """Per match and club: chains, their events, and own passes."""
    return chain_table(chained).groupBy("match_id", "club_id").agg(
        F.count("*").alias("n_chains"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("longest_chain"), F.sum("n_own_passes").alias("n_own_passes")
    )


def contest_events(events: DataFrame) -> DataFrame:
    return events.where(is_contest())

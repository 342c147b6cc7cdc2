"""Club-level statistics: field tilt, pressing, keepers, set pieces. Input: chained events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators.models import shots
from touchline.sources.matches import MAX_GAP, RESTART_TYPES

#: Shares of attempts under this number are not reported.
LEAST_DENOMINATOR = 10
# Where the pressing zone begins, as a share of the pitch.
PRESSING_ZONES = {"trainor": 0.4, "opta": 1 / 3}
KEEPER_ROLE = 1
# The primes of xxHash.
_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
#: Groups that a half's shuffles are dealt in; crosses times shuffles that are held at a time.
TRIAL_PARTS, MOST_DEALT = 16, 1 << 18
LENGTHS = [("short", 0.0, 1500.0), ("medium", 1500.0, 3000.0), ("long", 3000.0, float("inf"))]


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def share(part: Column, whole: Column, least: int = 1) -> Column:
    """A ratio; null where the denominator is 0 or under the least."""
    return F.when(whole >= least, part / F.when(whole > 0, whole))


def final_third_touches(events: DataFrame, pitch: G.Pitch = G.FIFA) -> DataFrame:
    """Per match and club, also for clubs without any."""
    return events.groupBy("match_id", "club_id").agg(_n(G.in_final_third(F.col("x"), pitch)).alias("touches"))


def field_tilt(events: DataFrame, pitch: G.Pitch = G.FIFA) -> DataFrame:
    """Each club's share of both clubs' events in their final thirds."""
    clubs = final_third_touches(events, pitch)
    total = F.sum("touches").over(Window.partitionBy("match_id"))
    return clubs.select("match_id", "club_id", "touches", total.alias("total_touches"), F.round(share(F.col("touches"), total), 4).alias("field_tilt"))


def ppda_components(events: DataFrame, pitch: G.Pitch = G.FIFA, zones: dict[str, float] | None = None) -> DataFrame:
    """Per match, half, pressing club and zone: opponents' passes and own tackles and blocks beyond the zone's line.

    An opponent's pass is looked at from the pressing club's side: its place is turned.
    """
    zones = zones or PRESSING_ZONES
    rows = events.select("match_id", "half", "club_id", "type", "x", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("pressing_club"))
    rows = rows.select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("zone"), F.lit(v * pitch.length).alias("line")) for k, v in zones.items()))))
    own = F.col("club_id") == F.col("pressing_club")
    passes = ~own & F.col("type").isin("pass", "cross") & (pitch.length - F.col("x") > F.col("line"))
    acts = lambda kind: own & (F.col("type") == kind) & (F.col("x") > F.col("line"))
    out = rows.groupBy("match_id", "half", "pressing_club", "zone").agg(_n(passes).alias("opponent_passes"), _n(acts("tackle")).alias("tackles"), _n(acts("block")).alias("blocks"))
    return out.withColumn("defensive_actions", F.col("tackles") + F.col("blocks"))


def ppda_team_half(components: DataFrame) -> DataFrame:
    """Components of a half; the ratio itself is never given for so few actions."""
    return components.withColumn("ppda", F.lit(None).cast("double"))


def ppda_pooled(components: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums first, one division last; zones never mix. Null without defensive actions."""
    out = components.groupBy(*(by or ["pressing_club", "zone"])).agg(*(F.sum(c).alias(c) for c in ("opponent_passes", "defensive_actions")))
    return out.withColumn("ppda", F.round(share(F.col("opponent_passes"), F.col("defensive_actions")), 4))


def keepers(events: DataFrame) -> DataFrame:
    """Per match, half and club the keeper, if exactly one player had that role; n_keepers says how many."""
    rows = events.where((F.col("role") == KEEPER_ROLE) & F.col("player_id").isNotNull())
    out = rows.groupBy("match_id", "half", "club_id").agg(F.countDistinct("player_id").alias("n_keepers"), F.max("player_id").alias("_one"))
    return out.select("match_id", "half", "club_id", "n_keepers", F.when(F.col("n_keepers") == 1, F.col("_one")).alias("keeper_id"))


def _defended(events: DataFrame) -> DataFrame:
    """Each shot with the one other club of its half (null if there is not exactly one) and that club's keeper."""
    clubs = events.groupBy("match_id", "half").agg(F.collect_set("club_id").alias("clubs"))  # the clubs of a half
    rows = shots(events).join(clubs, ["match_id", "half"])
    others = F.filter("clubs", lambda c: c != F.col("club_id"))
    rows = rows.withColumn("defending", F.when(F.size(others) == 1, others[0]))
    known = keepers(events).where("keeper_id is not null").select("match_id", "half", F.col("club_id").alias("defending"), "keeper_id")
    return rows.join(known, ["match_id", "half", "defending"], "left")


def keeper_sheet(events: DataFrame, buckets: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """Per keeper: distribution by length (attempted, completed, unknown), carries, shots and xG faced; saves are never seen: null."""
    buckets = buckets or LENGTHS
    known = keepers(events).where("keeper_id is not null").select("match_id", "half", "club_id", "keeper_id")
    acts = events.where("player_id is not null").join(known, ["match_id", "half", "club_id"]).where("player_id = keeper_id")
    length = G.distance(F.col("x"), F.col("y"), F.col("end_x"), F.col("end_y"))
    a_pass, unknown, done = F.col("type") == "pass", F.col("outcome") == "unknown", F.col("outcome") == "complete"
    columns = [
        _n(a_pass & ~unknown).alias("passes_attempted"), _n(a_pass & done).alias("passes_completed"), _n(a_pass & unknown).alias("passes_unknown_outcome"),
        _n(a_pass & F.col("end_x").isNull()).alias("passes_without_end_point"), _n(F.col("type") == "carry").alias("carries"),
    ]
    for name, _, _ in buckets:
        own = a_pass & (G.length_bucket(length, buckets) == name)
        columns += [_n(own & ~unknown).alias(f"{name}_attempted"), _n(own & done).alias(f"{name}_completed"), _n(own & unknown).alias(f"{name}_unknown")]
    played = acts.groupBy("match_id", "half", "keeper_id").agg(*columns)
    faced = _defended(events).where("keeper_id is not null").groupBy("match_id", "half", "keeper_id").agg(F.count("*").alias("shots_faced"), F.round(F.sum("xg"), 4).alias("xg_faced"))
    out = known.join(played, ["match_id", "half", "keeper_id"], "left").join(faced, ["match_id", "half", "keeper_id"], "left")
    counts = [c for c in out.columns if c not in known.columns]
    return out.select(*known.columns, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts), F.lit(None).cast("long").alias("saves"))


def unattributed_shots(events: DataFrame) -> DataFrame:
    """Per match and half, shots for which no keeper of record is known."""
    return _defended(events).groupBy("match_id", "half").agg(F.count("*").alias("n_shots"), _n(F.col("keeper_id").isNull()).alias("unattributed"))


def restarts(events: DataFrame, labelled: tuple[str, ...] = ("throw_in",)) -> DataFrame:
    """Per match and restart type: taken and deliveries by outcome. Types that the source does not label are null, not 0."""
    spark = events.sparkSession
    spine = events.select("match_id").distinct().join(F.broadcast(spark.createDataFrame([(t, t in labelled) for t in RESTART_TYPES], "type string, labelled boolean")))
    unknown, done = F.col("outcome") == "unknown", F.col("outcome") == "complete"
    found = events.where(F.col("type").isin(RESTART_TYPES)).groupBy("match_id", "type").agg(F.count("*").alias("taken"), _n(~unknown).alias("attempted"), _n(done).alias("completed"), _n(unknown).alias("unknown"))
    out = spine.join(found, ["match_id", "type"], "left")
    out = out.select("match_id", F.col("type").alias("restart"), *(F.when(F.col("labelled"), F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("taken", "attempted", "completed", "unknown")))
    return out.withColumn("completion_rate", F.round(share(F.col("completed"), F.col("attempted"), LEAST_DENOMINATOR), 4))


def takers(events: DataFrame, labelled: tuple[str, ...] = ("throw_in",)) -> DataFrame:
    """Deliveries per taker and labelled restart type."""
    unknown = F.col("outcome") == "unknown"
    rows = events.where(F.col("type").isin(list(labelled)) & F.col("player_id").isNotNull())
    out = rows.groupBy("match_id", "player_id", "club_id", "type").agg(_n(~unknown).alias("attempted"), _n(F.col("outcome") == "complete").alias("completed"), _n(unknown).alias("unknown"))
    return out.withColumn("completion_rate", F.round(share(F.col("completed"), F.col("attempted"), LEAST_DENOMINATOR), 4))


def shot_origins(events: DataFrame, source_labels_set_pieces: bool = False) -> DataFrame:
    """Per match, shots and xG from set pieces, from open play (null unless the source labels set pieces), and of unknown origin."""
    rows = shots(events, source_labels_set_pieces=source_labels_set_pieces)
    open_play = (F.col("origin") == F.lit(False)) & F.lit(source_labels_set_pieces)
    known = F.lit(source_labels_set_pieces)
    return rows.groupBy("match_id").agg(
        _n(F.col("origin")).alias("shots_from_set_piece"),
        F.round(F.coalesce(F.sum(F.when(F.col("origin"), F.col("xg"))), F.lit(0.0)), 4).alias("xg_from_set_piece"),
        F.when(known, _n(open_play)).alias("shots_open_play"),
        F.when(known, F.round(F.coalesce(F.sum(F.when(open_play, F.col("xg"))), F.lit(0.0)), 4)).alias("xg_open_play"),
        _n(F.col("origin").isNull()).alias("shots_unattributable"),
    )


def corner_candidates(events: DataFrame, pitch: G.Pitch = G.FIFA, radius: float = 300.0, min_gap: float = MAX_GAP) -> DataFrame:
    """Crosses from near an attacked corner flag after a pause; before a half's first event the pause is infinite."""
    rows = _crosses(events, pitch)
    return rows.where((F.col("flag_distance") <= radius) & (F.col("gap") > min_gap)).select("match_id", "half", "event_id", "club_id", "flag_distance", "gap")


def _crosses(events: DataFrame, pitch: G.Pitch) -> DataFrame:
    order = Window.partitionBy("match_id", "half").orderBy("frame_idx", "event_id")
    rows = events.withColumn("gap", F.coalesce(F.col("t") - F.lag("t").over(order), F.lit(float("inf")))).where("type = 'cross'")
    return rows.withColumns({"flag_distance": G.corner_flag_distance(F.col("x"), F.col("y"), pitch), "line_distance": G.touchline_distance(F.col("y"), pitch)})


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs after the hash `seed`, unsigned."""
    turn = lambda v, k: v << np.uint64(k) | v >> np.uint64(64 - k)
    h = seed + _XX[4] + np.uint64(8) ^ turn(x.view(np.uint64) * _XX[1], 31) * _XX[0]
    h = turn(h, 27) * _XX[0] + _XX[3]
    h = (h ^ h >> np.uint64(33)) * _XX[1]
    h = (h ^ h >> np.uint64(29)) * _XX[2]
    return h ^ h >> np.uint64(32)


def corner_null_test(events: DataFrame, pitch: G.Pitch = G.FIFA, radius: float = 300.0, min_gap: float = MAX_GAP, permutations: int = 2000, seed: int = 0) -> DataFrame:
    """Is nearness to the flag tied to pauses? Distances are dealt anew within each half, by hashed order; p = (1 + shuffles at least as many) / (1 + shuffles).

    baseline_p is the same for the distance to the touchline. A half's crosses go to TRIAL_PARTS groups, each of which deals them for its share of
    the shuffles, some at a time: no row is made for a cross and a shuffle.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = _crosses(events, pitch).select(
        "match_id", "half", F.col("event_id").cast("long").alias("event_id"),
        flag(F.col("gap") > min_gap).alias("late"), flag(F.col("flag_distance") <= radius).alias("near"), flag(F.col("line_distance") <= radius).alias("line"),
    )
    spark = events.sparkSession
    trials = spark.range(permutations).select((F.col("id") + 1).cast("int").alias("trial")).select("trial", F.xxhash64(F.lit(seed), "trial"))
    begun = np.array(trials.collect(), dtype=np.int64).reshape(-1, 2)  # each shuffle and the hash of seed and shuffle

    def deal(crosses: pa.Table) -> pa.Table:
        part = crosses.column("part")[0].as_py()
        ids = crosses.column("event_id").fill_null(np.iinfo(np.int64).min).to_numpy()  # nulls come first
        late, near, line = (crosses.column(c).to_numpy() for c in ("late", "near", "line"))
        late = late[np.argsort(ids, kind="stable")]
        marks = near.astype(np.uint64) | line.astype(np.uint64) << np.uint64(1)
        own = begun[part::TRIAL_PARTS]
        counts = [np.empty((0, 2), dtype=np.int64)]
        step = max(1, MOST_DEALT // len(ids))
        for at in range(0, len(own), step):
            # Marks take the place of the hash's last two bits, so that one sort orders and deals.
            keys = _hash_long(ids, own[at : at + step, 1].view(np.uint64)[:, None]) & ~np.uint64(3) | marks
            dealt = np.sort(keys.view(np.int64), axis=1)[:, late]
            counts.append(np.column_stack([(dealt & 1).sum(axis=1), (dealt >> 1 & 1).sum(axis=1)]))
        counts = np.concatenate(counts)
        return pa.table({"trial": own[:, 0].astype(np.int32), "n": counts[:, 0], "b": counts[:, 1]})

    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(TRIAL_PARTS - 1))))
    keys = ["match_id", "half", "part"]
    # Dealt into tasks by number: by its few bytes Spark would give all of it to one.
    each = parts.repartition(n_tasks, *keys).groupBy(*keys).applyInArrow(deal, "trial int, n long, b long").groupBy("trial").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    observed = rows.agg(F.count("*").alias("n_crosses"), _n(F.col("near")).alias("n_within"), _n(F.col("late")).alias("n_after_gap"), _n(F.col("near") & F.col("late")).alias("observed"), _n(F.col("line") & F.col("late")).alias("baseline_observed"))
    both = each.join(F.broadcast(observed))  # one row
    p = lambda c, o: (1 + F.count(F.when(F.col(c) >= F.col(o), 1))) / (1 + permutations)
    names = ["n_crosses", "n_within", "n_after_gap", "observed", "baseline_observed"]
    return both.groupBy(*names).agg(p("n", "observed").alias("p_value"), p("b", "baseline_observed").alias("baseline_p"))

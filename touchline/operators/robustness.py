"""How far statistics move when events go missing: scenarios of model, rate and trial, some in one plan."""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as G
from touchline.operators import chains, duels, models, players
from touchline.operators.teams import _hash_long
from touchline.sources.matches import CREATING_TYPES, MAX_GAP

#: Events of all scenarios that are rebuilt at a time, which is what takes disk; a scenario is never cut.
MOST_ROWS = 400_000
RATES, MODELS, TRIALS = (0.05, 0.1, 0.2, 0.4), ("uniform", "crowd-biased"), 20
#: Groups that a match's scenarios are dealt in by sheet_sweep().
SCENARIO_PARTS = 4
#: What sheet_sweep() reads of an event beside its place, club and player, one bit each.
_MARKS = ("has_half", "has_t", "has_event", "has_player", "has_club", "open", "held", "shot", "carry", "a_pass", "cross", "throw_in", "header", "creating", "ends", "inferred", "complete", "unknown", "attempt", "progressive", "enters", "touch")
_COUNTED = ("n_events", "count_passes_attempted", "completed", "count_progressive_actions", "count_touches_in_opp_box", "count_final_third_entries", "count_key_passes", "count_sca", "count_recoveries", "count_shots", "total_xg")


#: Pairs of model and rate, and the trials that each of them has.
Batch = tuple[list[tuple[str, float]], list[int]]


def crowding(events: DataFrame, radius: float = G.CROWD_RADIUS) -> DataFrame:
    """Adds crowd: team-mates and opponents within the radius."""
    x, y = F.col("x"), F.col("y")
    return events.withColumn("crowd", G.within(x, y, F.col("opponents"), radius) + G.within(x, y, F.col("teammates"), radius))


def _chances(n: np.ndarray, crowd: np.ndarray, rates: tuple[float, ...], models: tuple[str, ...], strength: float = 2.0, rounds: int = 20) -> dict[tuple[str, float], np.ndarray]:
    """For each model and rate, the probability that an event goes missing, for each crowding of a match that n events have."""
    n, crowd, out = n.astype(float), crowd.astype(float), {}
    mean = (n * crowd).sum() / n.sum()
    for model in models:
        weight = (1 + strength * (crowd - mean) / (mean + 1)).clip(0.05) if model == "crowd-biased" else crowd * 0 + 1
        for rate in rates:
            p = rate * weight / ((n * weight).sum() / n.sum())
            for _ in range(rounds):
                p = p.clip(None, 1.0)
                lost, left = rate * n.sum() - (n * p).sum(), (n * p)[p < 1].sum()
                if lost <= 1e-9 or left <= 0:
                    break
                p[p < 1] *= 1 + lost / left
            out[model, rate] = p.clip(None, 1.0)
    return out


def scenarios(events: DataFrame, rates: tuple[float, ...] = RATES, models: tuple[str, ...] = MODELS, trials: int = TRIALS, seed: int = 0, strength: float = 2.0, rounds: int = 20, only: Batch | None = None) -> DataFrame:
    """The events that survive each scenario, or only those of a batch: columns model, rate, trial beside their own.

    An event goes missing where a hashed number falls below its probability: the rate itself, or the rate weighted by crowding within the match
    and clipped to 1, what is lost by clipping dealt to the others, round by round. Equally crowded events of a match share a probability.
    """
    rows = crowding(events)
    cells = rows.groupBy("match_id", "crowd").agg(F.count("*").alias("n"))

    def deal(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("crowd")
        chances = _chances(cells["n"].to_numpy(), cells["crowd"].to_numpy(), rates, models, strength, rounds)
        out = [cells[["match_id", "crowd"]].assign(model=model, rate=rate, _p=p) for (model, rate), p in chances.items() if not only or (model, rate) in only[0]]
        return pd.concat(out)

    kind = events.schema["match_id"].dataType.simpleString()
    dealt = cells.groupBy("match_id").applyInPandas(deal, f"match_id {kind}, crowd int, model string, rate double, _p double")
    dealt = dealt.withColumnsRenamed({"match_id": "_match", "crowd": "_crowd"})
    rows = rows.join(dealt, F.col("match_id").eqNullSafe(F.col("_match")) & (F.col("crowd") == F.col("_crowd")))
    numbers = only[1] if only else range(1, trials + 1)
    rows = rows.withColumn("trial", F.explode(F.array(*map(F.lit, numbers))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "model", "rate", "trial", "match_id", "event_id"), 11) * F.lit(2.0**-53)
    return rows.where(u >= F.col("_p")).select(*events.columns, "model", "rate", "trial")


def _long(wide: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts and totals of each value of the keys with their ratios, a row each."""
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    ratios = {
        "ratio_pass_completion": share("completed", "count_passes_attempted"),
        "ratio_progressive_share": share("count_progressive_actions", "count_passes_attempted"),
        "ratio_field_tilt_box_share": share("count_touches_in_opp_box", "n_events"),
    }
    found = {c: F.col(c) for c in wide.columns if c not in (*keys, "n_events", "completed")} | ratios
    return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("stat"), v.alias("value")) for k, v in found.items()))))


def statistics(events: DataFrame, keys: tuple[str, ...] = (), max_gap: float = MAX_GAP, pitch: G.Pitch = G.FIFA) -> DataFrame:
    """Counts, totals and ratios of the tier-one sheet over all matches, for each value of the keys: columns stat and value beside the keys.

    Chains and outcomes are built anew within each; ends are what the events say. A ratio without a denominator is 0.
    """
    live = events.where(~F.col("replay"))
    opponents = F.when(F.col("type") == "shot", F.col("opponents"))  # xG alone reads them
    read = ["half", "event_id", "frame_idx", "t", "type", "player_id", "club_id", "x", "y", "end_x", "end_y", "outcome", "outcome_source", "replay", *(c for c in ("is_header",) if c in events.columns)]
    rows = live.select(F.struct(*keys, "match_id").alias("match_id"), *read, opponents.alias("opponents"))
    chained = chains.with_chains(rows, max_gap).persist(StorageLevel.DISK_ONLY)
    each = [F.col(f"match_id.{k}").alias(k) for k in keys]
    total = lambda rows, **sums: rows.groupBy(*each).agg(*(F.sum(v).cast("double").alias(k) for k, v in sums.items()))
    moves = F.col("progressive_passes") + F.col("progressive_carries")
    entries = F.col("final_third_entries_pass") + F.col("final_third_entries_carry")
    parts = [
        total(chained, n_events=F.lit(1)),
        total(players.passing(chained, pitch), count_passes_attempted=F.col("passes_attempted"), completed=F.col("passes_completed")),
        total(players.progression(chained, pitch), count_progressive_actions=moves, count_touches_in_opp_box=F.col("touches_in_opp_box"), count_final_third_entries=entries),
        total(players.key_passes(chained), count_key_passes=F.lit(1)),
        total(players.shot_creating_actions(chained), count_sca=F.lit(1)),
        total(duels.balls_by_player(chained, pitch, max_gap), count_recoveries=F.col("recoveries")),
        total(models.shots(chained, pitch).where("player_id is not null"), count_shots=F.lit(1), total_xg=F.col("xg")),
    ]
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.unionByName(part, allowMissingColumns=True)
    names = [c for c in wide.columns if c not in keys]
    wide = wide.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names))
    long = _long(wide, keys)
    try:
        return events.sparkSession.createDataFrame(long.collect(), long.schema)  # a dozen rows a scenario
    finally:
        chained.unpersist()


def batches(n_events: int, rates: tuple[float, ...], models: tuple[str, ...], trials: int) -> list[Batch]:
    """All scenarios, each once, in batches of at most MOST_ROWS events: whole pairs of model and rate, else some trials of one pair, one at least."""
    pairs, every = [(m, r) for m in models for r in rates], list(range(1, trials + 1))
    at_once = max(1, MOST_ROWS // max(1, n_events))
    step = at_once // trials
    if step:
        return [(pairs[i : i + step], every) for i in range(0, len(pairs), step)]
    return [([pair], every[i : i + at_once]) for pair in pairs for i in range(0, trials, at_once)]


def sweep(events: DataFrame, compute: Callable[..., DataFrame], rates: tuple[float, ...] = RATES, models: tuple[str, ...] = MODELS, trials: int = TRIALS, seed: int = 0, signed: tuple[str, ...] = ()) -> DataFrame:
    """movements() of what compute(events, keys) finds among the events without replays; it is called for all of them and once for each batch of scenarios.

    What it finds, some rows a scenario, comes to the driver, and a batch's files go before the next. A scenario without events counts 0 everywhere.
    """
    spark = events.sparkSession
    live = events.where(~F.col("replay")).persist(StorageLevel.DISK_ONLY)
    keys = ("model", "rate", "trial")
    try:
        found = compute(live, ())
        baseline = spark.createDataFrame(found.collect(), found.schema)
        rows, schema = [], None
        for batch in batches(live.count(), rates, models, trials):
            found = compute(scenarios(live, rates, models, trials, seed, only=batch), keys)
            rows, schema = rows + found.collect(), found.schema
            del found
            gc.collect()
            spark._jvm.System.gc()  # else shuffle files stay until the driver happens to collect its garbage
    finally:
        live.unpersist()
    grid = [(m, float(r), t) for m in models for r in rates for t in range(1, trials + 1)]
    every = spark.createDataFrame(grid, "model string, rate double, trial int").crossJoin(F.broadcast(baseline.select("stat")))
    return movements(baseline, every.join(spark.createDataFrame(rows, schema), [*keys, "stat"], "left"), signed)


def _marked(live: DataFrame, pitch: G.Pitch) -> DataFrame:
    """Events as sheet_sweep() deals them: all that depends on an event alone is found here, as marks and two values of a shot."""
    kind = lambda *names: F.col("type").isin(*names)
    actor, ended, a_pass = F.col("player_id").isNotNull(), F.col("end_x").isNotNull(), kind("pass", "cross")
    moves = (a_pass | kind("carry")) & actor & ended
    conditions = {
        "has_half": F.col("half").isNotNull(), "has_t": F.col("t").isNotNull(), "has_event": F.col("event_id").isNotNull(), "has_player": actor, "has_club": F.col("club_id").isNotNull(),
        "open": ~chains.is_contest(), "held": chains.is_possession(), "a_pass": a_pass, "creating": kind(*CREATING_TYPES), "ends": kind("shot", "throw_in"),
        **{k: kind(k) for k in ("shot", "carry", "cross", "throw_in")}, "header": models._is_header(live),
        "inferred": (F.col("outcome_source") != "labelled") & kind(*chains._INFERRED), "complete": F.col("outcome") == "complete", "unknown": F.col("outcome") == "unknown",
        "attempt": a_pass & actor & ended, "progressive": moves & players.is_progressive(pitch), "enters": moves & ~G.in_final_third(F.col("x"), pitch) & G.in_final_third(F.col("end_x"), pitch),
        "touch": actor & G.in_box(F.col("x"), F.col("y"), pitch),
    }
    marks = reduce(lambda a, b: a.bitwiseOR(b), (F.when(conditions[k], 1 << i).otherwise(0) for i, k in enumerate(_MARKS)))
    least = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63))).alias(c)  # noqa: E731  # nulls come first
    value = lambda s: F.when(kind("shot") & actor, F.coalesce(models.shot_xg(live, s, pitch), F.lit(0.0))).otherwise(0.0)
    rows = crowding(live)
    return rows.select(
        "match_id", least("half"), least("frame_idx"), least("event_id"), F.col("t").cast("double").alias("t"), F.coalesce(F.col("club_id").cast("long"), F.lit(0)).alias("club"), F.coalesce(F.col("player_id").cast("long"), F.lit(0)).alias("player"), "crowd",
        marks.alias("marks"), value(False).alias("xg"), value(True).alias("xg_set"),
    )


def _before(flags: np.ndarray) -> np.ndarray:
    """For each place the last flagged one before it, -1 if there is none."""
    out = np.full(len(flags), -1)
    np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1)[:-1], out=out[1:])
    return out


def _counts(e: dict[str, np.ndarray], max_gap: float) -> tuple:
    """_COUNTED of one match's events in their order: chains.with_chains() and the sheets of statistics(), without rows for what they join."""
    half, t, club, player, n = e["half"], e["t"], e["club"], e["player"], len(e["t"])
    if not n:
        return (0,) * len(_COUNTED)
    is_ = {k: e["marks"] & (1 << i) != 0 for i, k in enumerate(_MARKS)}
    has_half, has_club, actor, free, at = is_["has_half"], is_["has_club"], is_["has_player"], is_["open"], np.arange(n)

    # A match, a half or a pause cuts; another club's event that is no contest begins a chain too.
    cut = np.ones(n, dtype=bool)
    cut[1:] = (half[1:] != half[:-1]) | ~has_half[:-1] | (is_["has_t"][1:] & is_["has_t"][:-1] & ~(t[1:] - t[:-1] <= max_gap))
    holder = _before((cut | free) & has_club)
    starts = cut | (free & has_club & (holder >= np.maximum.accumulate(np.where(cut, at, 0))) & (club[holder] != club))
    begin, first = np.maximum.accumulate(np.where(starts, at, 0)), np.flatnonzero(starts)

    later = np.full(n, n)
    later[:-1] = np.minimum.accumulate(np.where(is_["held"], at, n)[:0:-1])[::-1]
    i = np.flatnonzero(is_["inferred"])
    j = np.minimum(later[i], n - 1)
    live = (later[i] < n) & has_half[i] & (half[i] == half[j]) & (t[j] - t[i] <= max_gap)
    complete, unknown = is_["complete"], is_["unknown"]
    complete[i], unknown[i] = live & has_club[i] & has_club[j] & (club[i] == club[j]), ~live
    attempted = is_["attempt"] & ~unknown

    shot = np.flatnonzero(is_["shot"])
    key_passes, earlier, k = 0, _before(free), shot[actor[shot]]
    j = earlier[k]
    while len(k):  # back over the shooter's own carries
        within = j >= begin[k]
        k, j = k[within], j[within]
        same = has_club[j] & has_club[k] & (club[j] == club[k])
        own = is_["carry"][j] & actor[j] & (player[j] == player[k]) & (same | ~has_club[j] | ~has_club[k])
        key_passes += np.count_nonzero(~own & same & is_["a_pass"][j] & actor[j] & (player[j] != player[k]))
        k, j = k[own], earlier[j[own]]

    # Within a chain, all clubs of events that are no contest are one.
    action, k, sca = _before(is_["creating"] & has_club), shot[has_club[shot]], 0
    j = action[k]
    for _ in range(2):
        within = j >= begin[k]
        k, j = k[within], j[within]
        sca += np.count_nonzero(actor[j])
        on = ~is_["ends"][j]
        k, j = k[on], action[j[on]]

    # Its first event is a chain's first own one, and whoever of its club acts in the open holds the ball there.
    last, holds = np.append(first[1:] - 1, n - 1), np.append(0, np.cumsum(is_["held"] & has_club))
    held = has_club[first] & (holds[last + 1] > holds[first])
    gain, lost = first[1:], last[:-1]
    change = held[1:] & held[:-1] & (club[gain] != club[first[:-1]]) & has_half[gain] & (half[gain] == half[lost]) & (t[gain] - t[lost] <= max_gap)

    k = shot[actor[shot]]
    restart = ~starts[k] & (is_["throw_in"][k - 1] | (is_["header"][k] & is_["cross"][k - 1]))
    count = np.count_nonzero
    return (
        n, count(attempted), count(attempted & complete), count(complete & is_["progressive"]), count(is_["touch"]), count(complete & is_["enters"]), key_passes, sca,
        count(change & actor[gain]), len(k), float(np.where(restart, e["xg_set"][k], e["xg"][k]).sum()),
    )


def sheet_sweep(events: DataFrame, rates: tuple[float, ...] = RATES, models: tuple[str, ...] = MODELS, trials: int = TRIALS, seed: int = 0, max_gap: float = MAX_GAP, pitch: G.Pitch = G.FIFA, signed: tuple[str, ...] = ()) -> DataFrame:
    """sweep() of statistics(), the same scenarios and figures, but no row is made for an event and a scenario.

    A match's events go to SCENARIO_PARTS groups, each of which rebuilds its share of the scenarios one by one and returns their counts; a match must fit a
    worker. event_id is a key within a match. Ids that are no numbers (or no longs, where they are hashed) go the way of sweep().
    """
    kinds, whole = dict(events.dtypes), ("tinyint", "smallint", "int", "bigint")
    if any(kinds[c] != "bigint" for c in ("match_id", "event_id")) or any(kinds[c] not in whole for c in ("half", "frame_idx", "club_id", "player_id")):
        return sweep(events, lambda rows, keys: statistics(rows, keys, max_gap, pitch), rates, models, trials, seed, signed)
    spark, keys = events.sparkSession, ("model", "rate", "trial")
    grid = [(m, float(r), t) for m in models for r in rates for t in range(1, trials + 1)]
    every = spark.createDataFrame(grid, "model string, rate double, trial int")
    begun = {(r.model, r.rate, r.trial): r.h for r in every.select(*keys, F.xxhash64(F.lit(seed), *keys).alias("h")).collect()}
    hashes = np.array([begun[k] for k in grid], dtype=np.int64).view(np.uint64)

    def deal(rows: pa.Table) -> pa.Table:
        part, match = rows.column("part")[0].as_py(), rows.column("match_id")[0].as_py()
        e = {c: rows.column(c).to_numpy() for c in ("half", "frame_idx", "event_id", "t", "club", "player", "crowd", "marks", "xg", "xg_set")}
        order = np.lexsort((e["event_id"], e["frame_idx"], e["half"]))
        e = {c: v[order] for c, v in e.items()}
        ids, named, crowd = e.pop("event_id"), e["marks"] & (1 << _MARKS.index("has_event")) != 0, e.pop("crowd")
        del e["frame_idx"]
        cells, cell, n = np.unique(crowd, return_inverse=True, return_counts=True)
        # A number in [0, 1) of 53 bits is at least p where its bits are at least so many.
        bars = {k: np.ceil(p * 2.0**53).astype(np.uint64) for k, p in _chances(n, cells, rates, models).items()}
        own = range(part, len(grid), SCENARIO_PARTS)
        of_match = hashes if match is None else _hash_long(np.full(len(grid), match), hashes)
        found = [(-1, *_counts(e, max_gap))] if part == 0 else []
        for i in own:
            drawn = _hash_long(ids, of_match[i : i + 1])
            if not named.all():
                drawn[~named] = of_match[i]
            kept = np.flatnonzero(drawn >> np.uint64(11) >= bars[grid[i][0], grid[i][1]][cell])
            found.append((i, *_counts({c: v[kept] for c, v in e.items()}, max_gap)))
        return pa.table({c: pa.array(v, kind) for (c, kind), v in zip(schema.items(), zip(*found, strict=True) if found else [[]] * len(schema), strict=True)})

    schema = {"scenario": pa.int32()} | dict.fromkeys(_COUNTED, pa.int64()) | {"total_xg": pa.float64()}
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = _marked(events.where(~F.col("replay")), pitch).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SCENARIO_PARTS - 1))))
    # Dealt into tasks by number: by its few bytes Spark would give all of it to one.
    each = rows.repartition(n_tasks, "match_id", "part").groupBy("match_id", "part").applyInArrow(deal, ", ".join(f"{c} {names[k]}" for c, k in schema.items()))
    sums = {r.scenario: tuple(map(float, r[1:])) for r in each.groupBy("scenario").agg(*(F.sum(c).alias(c) for c in _COUNTED)).collect()}  # a row a scenario
    none, columns = (0.0,) * len(_COUNTED), ", ".join(f"{c} double" for c in _COUNTED)
    baseline = _long(spark.createDataFrame([sums.get(-1, none)], columns), ())
    stats = _long(spark.createDataFrame([(*k, *sums.get(i, none)) for i, k in enumerate(grid)], f"model string, rate double, trial int, {columns}"), keys)
    return movements(baseline, stats, signed)


def movements(baseline: DataFrame, stats: DataFrame, signed: tuple[str, ...] = ()) -> DataFrame:
    """Mean movement of each statistic per model and rate: relative, or absolute where the baseline is 0 or the statistic signed.

    baseline: stat, value; stats: model, rate, trial, stat, value (a missing one counts 0).
    """
    trials = stats.select("model", "rate", "trial").distinct()
    base = baseline.select("stat", F.col("value").alias("base"))
    rows = trials.join(F.broadcast(base)).join(stats, ["model", "rate", "trial", "stat"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))  # a few statistics
    moved = F.abs(F.col("value") - F.col("base"))
    absolute = (F.col("base") == 0) | F.col("stat").isin(list(signed))
    relative = F.when(~absolute, moved / F.abs("base"))
    return rows.groupBy("stat", "model", "rate", "base").agg(
        F.count("*").alias("n_trials"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.avg(relative), 4).alias("mean_relative_movement"), F.round(F.stddev_pop(relative), 4).alias("std_relative_movement"),
        F.round(F.avg(F.when(absolute, moved)), 4).alias("mean_absolute_movement"),
    )


def gating(moves: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """The highest rate up to which every model keeps a statistic within the tolerance at each lower rate too; 0 if none."""
    rated = moves.where("mean_relative_movement is not null")
    n_models = rated.agg(F.countDistinct("model")).first()[0]
    ok = rated.groupBy("stat", "rate").agg(((F.count("*") == n_models) & F.bool_and(F.col("mean_relative_movement") <= tolerance)).alias("ok"))
    run = Window.partitionBy("stat").orderBy("rate")
    held = ok.withColumn("held", F.bool_and("ok").over(run))
    return held.groupBy("stat").agg(F.coalesce(F.max(F.when(F.col("held"), F.col("rate"))), F.lit(0.0)).alias("tolerated_rate"))

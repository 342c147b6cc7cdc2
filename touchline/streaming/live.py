"""Structured Streaming forms of the order-dependent operators.

Event time is media time as a timestamp. A watermark of the chain gap bounds state: once it has passed, a bucket or session is final and its
rows go out, late rows are dropped. Every function also works on a batch DataFrame, which gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """Events and their types per match and bucket. events: match_id, ts, type."""
    rows = events.withWatermark("ts", late).groupBy("match_id", F.window("ts", f"{seconds} seconds").alias("w"))
    return rows.agg(F.count("*").alias("n_events"), F.count(F.when(F.col("type") == "shot", 1)).alias("n_shots")).select("match_id", F.col("w.start").alias("start"), "n_events", "n_shots")


def sliding_means(scores: DataFrame, length: str, slide: str, late: str = "10 seconds") -> DataFrame:
    """Mean score over overlapping windows. scores: match_id, ts, score."""
    rows = scores.withWatermark("ts", late).groupBy("match_id", F.window("ts", length, slide).alias("w"))
    return rows.agg(F.avg("score").alias("score"), F.count("*").alias("n")).select("match_id", F.col("w.start").alias("start"), "score", "n")


def sessions(events: DataFrame, gap_s: int = 10, late: str = "10 seconds") -> DataFrame:
    """Stretches of play without a pause over gap_s: the segments of chains, not the chains, which also end with the club.

    Both here and in chains a pause of exactly gap_s does not end a stretch: the session's gap is a microsecond longer.
    """
    rows = events.withWatermark("ts", late).groupBy("match_id", F.session_window("ts", f"{gap_s} seconds 1 microsecond").alias("w"))
    return rows.agg(F.count("*").alias("n_events"), F.min("ts").alias("start"), F.max("ts").alias("end")).select("match_id", "start", "end", "n_events")


_HOLDS = "clip long, frame long, kind string, player_id long, from_player_id long, confidence double, contested boolean"
_HOLD = "player long, team long, start long, last long, sure double, n long"
_STATE = f"holder struct<{_HOLD.replace(' long', ': long').replace(' double', ': double')}>, pending struct<{_HOLD.replace(' long', ': long').replace(' double', ': double')}>, out boolean, last_frame long"
#: How long a clip's state is kept without new frames, in milliseconds.
IDLE_MS = 3_600_000


class _Hold:
    """A stretch of one player's frames: its first and last one and the sum of their confidences."""

    def __init__(self, player: int, team: int | None, start: int, last: int, sure: float = 0.0, n: int = 0) -> None:
        self.player, self.team, self.start, self.last, self.sure, self.n = player, team, start, last, sure, n

    def add(self, frame: int, confidence: float) -> None:
        self.last, self.sure, self.n = frame, self.sure + confidence, self.n + 1

    @property
    def confidence(self) -> float:
        return self.sure / self.n

    @property
    def state(self) -> tuple:
        return (self.player, self.team, self.start, self.last, self.sure, self.n)


class _Machine:
    """Who holds the ball: confirmed after `hold` near frames, with restarts after the ball was out.

    A pass, good or missed, is of the holder's last frame and the touch of the new one's first; a gain and a restart are of the frame that confirms.
    """

    def __init__(self, state: tuple | None, hold: int) -> None:
        holder, pending, self.out, self.last = state or (None, None, False, -1)
        self.holder, self.pending = (x and _Hold(*x) for x in (holder, pending))
        self.hold = hold

    def step(self, frame: int, player: int | None, team: int | None, out: bool, confidence: float, contested: bool) -> Iterator[tuple]:
        self.last, self.out = frame, self.out or out
        held = self.holder
        if player is None:
            self.pending = None
            return
        if held and player == held.player:
            held.add(frame, confidence)
            self.pending = None
            return
        if not self.pending or player != self.pending.player:
            self.pending = _Hold(player, team, frame, frame)
        self.pending.add(frame, confidence)
        if self.pending.n < self.hold:
            return
        new, self.pending = self.pending, None
        if self.out:
            yield frame, "restart", player, None, new.confidence, contested
            self.out = False
        elif held:
            both = min(held.confidence, new.confidence)
            if held.team is not None and held.team == new.team:
                yield held.last, "pass", held.player, player, both, contested
            else:
                yield held.last, "missed_pass", held.player, player, both, contested
                yield frame, "possession_gain", player, held.player, new.confidence, contested
        yield new.start, "touch", player, None, new.confidence, contested
        self.holder = new

    @property
    def state(self) -> tuple:
        return (self.holder and self.holder.state, self.pending and self.pending.state, self.out, self.last)


def _nullable(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def _run(clip: int, rows: pd.DataFrame, machine: _Machine) -> pd.DataFrame:
    rows = rows[rows["frame"] > machine.last].sort_values("frame")
    sure = rows["confidence"] if "confidence" in rows else pd.Series(1.0, rows.index)
    close = rows["contested"] if "contested" in rows else pd.Series(False, rows.index)
    out = []
    for frame, player, team, gone, p, c in zip(rows["frame"], rows["player_id"], rows["team"], rows["out"], sure, close, strict=True):
        out += [(clip, *x) for x in machine.step(int(frame), _nullable(player), _nullable(team), bool(gone), float(p), bool(c))]
    found = pd.DataFrame(out, columns=["clip", "frame", "kind", "player_id", "from_player_id", "confidence", "contested"])
    return found.astype({"player_id": "Int64", "from_player_id": "Int64", "confidence": "float64", "contested": "bool"}).round({"confidence": 4})


def possession_events(frames: DataFrame, hold: int = 3, idle_ms: int = IDLE_MS) -> DataFrame:
    """Passes, missed passes, gains, restarts and touches from the nearest player of each frame, as a keyed state machine.

    frames: clip, frame, player_id and team of the player within reach (null: nobody; null team: unknown), out (the ball left the pitch), and optionally
    confidence and contested (another player is about as near). Frames of a clip must come in order; those at or before the last one seen are dropped.
    from_player_id is the receiver of a pass and the other side of a change. In a stream a clip without new frames for idle_ms is forgotten.
    """
    if not frames.isStreaming:
        return frames.groupBy("clip").applyInPandas(lambda key, rows: _run(int(key[0]), rows, _Machine(None, hold)), _HOLDS)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = _Machine(state.get if state.exists else None, hold)
        found = _run(int(key[0]), pd.concat(list(batches)), machine)
        state.update(machine.state)
        state.setTimeoutDuration(idle_ms)
        yield found

    return frames.groupBy("clip").applyInPandasWithState(advance, _HOLDS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


_SMOOTHED = "clip long, frame long, homography array<array<double>>, confidence double, status string"
_CARRY = "held array<array<double>>, sure double, carried long, last_frame long"


def smoothed_homographies(frames: DataFrame, alpha: float = 0.4, most_carried: int = 10, decay: float = 0.9, idle_ms: int = IDLE_MS) -> DataFrame:
    """Exponential mean of homographies, carried for at most most_carried frames without one, with fading confidence.

    frames: clip, frame, homography (array of rows or null), confidence. Adds status fresh, smoothed, carried or absent. In a stream the mean goes on
    from file to file: frames of a clip must come in order, those at or before the last one seen are dropped, and a clip without new frames for idle_ms is forgotten.
    """

    def smooth(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        held, sure, carried, last = state
        held = None if held is None else [[float(v) for v in row] for row in held]
        out = []
        for _, r in rows[rows["frame"] > last].sort_values("frame").iterrows():
            if r["homography"] is not None:
                h = [[float(v) / float(r["homography"][2][2]) for v in row] for row in r["homography"]]
                status = "fresh" if held is None else "smoothed"
                held = h if held is None else [[alpha * a + (1 - alpha) * b for a, b in zip(x, y, strict=True)] for x, y in zip(h, held, strict=True)]
                sure, carried = float(r["confidence"]), 0
            elif held is not None and carried < most_carried:
                carried, sure, status = carried + 1, sure * decay, "carried"
            else:
                held, sure, status = None, 0.0, "absent"
            last = int(r["frame"])
            out.append((int(r["clip"]), last, held, sure, status))
        return pd.DataFrame(out, columns=["clip", "frame", "homography", "confidence", "status"]), (held, sure, carried, last)

    start = (None, 0.0, 0, -1)
    if not frames.isStreaming:
        return frames.groupBy("clip").applyInPandas(lambda rows: smooth(rows, start)[0], _SMOOTHED)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found, after = smooth(pd.concat(list(batches)), state.get if state.exists else start)
        state.update(after)
        state.setTimeoutDuration(idle_ms)
        yield found

    return frames.groupBy("clip").applyInPandasWithState(advance, _SMOOTHED, _CARRY, "append", GroupStateTimeout.ProcessingTimeTimeout)

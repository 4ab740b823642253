"""Streaming operators: a floor gate per session, frame windows with a watermark, causality of late features."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.arrays import best_action

THRESHOLD, FRAMES = 0.6, 2
OUT_OF_PLAY = ["wait", "unratable"]
GATE_SCHEMA = "session_id string, frame bigint, state string"


def candidates(frames: DataFrame, probabilities: str = "probabilities", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``candidate``: the action in play with the greatest probability (of equals the greater name) if it reaches the threshold."""
    best = best_action(probabilities, OUT_OF_PLAY)
    return frames.withColumn("candidate", F.when(best.p >= threshold, best.action))


def gate_batch(frames: DataFrame, needed: int = FRAMES) -> DataFrame:
    """State after each frame: LISTEN while someone speaks; HOLD; an action once it has been the candidate ``needed``
    frames in a row; the last action stays while another candidate gathers its frames.

    ``frames``: session_id, frame, active (someone speaks), candidate.
    """
    w = Window.partitionBy("session_id").orderBy("frame")
    quiet = ~F.col("active")
    key = F.when(quiet, F.coalesce("candidate", F.lit(""))).otherwise(F.lit("*"))
    marked = frames.withColumn("_key", key)
    changed = F.coalesce((F.col("_key") != F.lag("_key").over(w)).cast("int"), F.lit(1))
    marked = marked.withColumn("_run", F.sum(changed).over(w))
    run = Window.partitionBy("session_id", "_run").orderBy("frame")
    marked = marked.withColumn("_n", F.row_number().over(run))
    # what this frame sets: nothing while a new candidate is still gathering
    sets = F.when(~quiet, "listen").when(F.col("candidate").isNull(), "hold").when(F.col("_n") >= needed, F.col("candidate"))
    marked = marked.withColumn("_sets", sets)
    before = F.last("_sets", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("_sets").isNotNull(), F.col("_sets")).when(before.isNull() | (before == "listen"), "hold").otherwise(before)
    return marked.select("session_id", F.col("frame").cast("bigint").alias("frame"), state.alias("state"))


class Gate:
    """The same as a machine that takes one frame after the other."""

    def __init__(self, needed: int = FRAMES, state: str = "listen", candidate: str = "", n: int = 0, last: int = -1) -> None:
        self.needed, self.state, self.candidate, self.n, self.last = needed, state, candidate, n, last

    def step(self, frame: int, active: bool, candidate: str | None) -> str:
        self.last = frame
        if active:
            self.state, self.candidate, self.n = "listen", "", 0
            return self.state
        if self.state == "listen":
            self.state = "hold"
        if not candidate:
            self.state, self.candidate, self.n = "hold", "", 0
            return self.state
        self.n = self.n + 1 if candidate == self.candidate else 1
        self.candidate = candidate
        if self.n >= self.needed:
            self.state = candidate
        return self.state

    def saved(self) -> tuple[str, str, int, int]:
        return self.state, self.candidate, self.n, self.last


def gate_stream(frames: DataFrame, needed: int = FRAMES) -> DataFrame:
    """``gate_batch`` on a stream: one small state per session. Frames of a micro-batch are taken in order; a frame that
    comes after a later one has been decided is dropped, as an online gate can't take back its state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        gate = Gate(needed, *state.get) if state.exists else Gate(needed)
        rows = pd.concat(list(frames), ignore_index=True).sort_values("frame").drop_duplicates("frame")
        rows = rows[rows["frame"] > gate.last]
        out = [(key[0], int(f), gate.step(int(f), bool(a), c if isinstance(c, str) else None)) for f, a, c in zip(rows["frame"], rows["active"], rows["candidate"], strict=True)]
        state.update(gate.saved())
        yield pd.DataFrame(out, columns=["session_id", "frame", "state"])

    return frames.groupBy("session_id").applyInPandasWithState(update, GATE_SCHEMA, "state string, candidate string, n bigint, last bigint", "append", "NoTimeout")


def frame_windows(events: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "1 hour", groups: list[str] | None = None) -> DataFrame:
    """Counts per tumbling (or sliding) window with a watermark, in batch or stream."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = events.withWatermark(ts, late).groupBy(window.alias("w"), *(groups or [])).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *(groups or []), "n")


def silence_sessions(events: DataFrame, ts: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Stretches of activity that a silence of ``gap`` ends."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def causal(features: DataFrame, available: Column, cutoff: Column, slack: float = 1e-9) -> DataFrame:
    """Only features that were there at the cutoff."""
    return features.where(available <= cutoff + slack)


def available_at(frames: DataFrame, horizon: int, frame_ms: int = 80) -> DataFrame:
    """A score that needs the frame ``horizon`` later can be used only then."""
    return frames.withColumn("available_ms", (F.col("frame") + 1 + horizon) * frame_ms)

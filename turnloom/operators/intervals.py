"""Intervals of speech: merging, episodes, checkpoints, overlap classes. Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.running import extreme, neighbour, placed, running
from turnloom.runtime import spill

#: Length of the pieces that long sessions are cut into.
SLICE_MS = 600_000


def positive(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    return df.where(F.col(end) > F.col(start))


def _with_previous(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return neighbour(df.where(" and ".join(f"{c} is not null" for c in [*keys, start])), keys, F.floor(F.col(start) / SLICE_MS), [start, end], end, "_prev")


def merge_touching(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Sorted, non-overlapping intervals of each key with touching neighbours joined.

    Rows of keys with overlapping intervals are left out: see ``overlapping_keys`` for them. Rows without a key or start too.
    """
    marked = spill(_with_previous(df, keys, start, end), "previous")  # read for the bad keys and for the islands
    bad = marked.where(F.col(start) < F.col("_prev")).select(*keys).distinct()
    good = marked.join(bad, keys, "left_anti").withColumn("_opens", F.coalesce((F.col(start) != F.col("_prev")).cast("int"), F.lit(1)))
    islands = running(good, keys, F.floor(F.col(start) / SLICE_MS), [start, end], {"_island": F.col("_opens")})
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlapping_keys(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Keys that have an interval starting before the one in front of it ends, with their number."""
    return _with_previous(df, keys, start, end).where(F.col(start) < F.col("_prev")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_overlaps"))


def episodes(merged: DataFrame, key: str = "session_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Silence after each interval: episode number from 0, onset, next onset, and whether the last one is censored."""
    slot = F.floor(F.col(start) / SLICE_MS)
    numbered = placed(merged.select(key, start, end), [key], slot, [start], "_n")
    following = neighbour(numbered, [key], slot, [start], start, "next_ms", forward=True)
    return following.select(key, (F.col("_n") - 1).alias("episode"), F.col(end).alias("onset_ms"), "next_ms").withColumn("right_censored", F.col("next_ms").isNull())


def stab(points: DataFrame, intervals: DataFrame, key: str, at: str, name: str, start: str = "start_ms", end: str = "end_ms", slice_ms: int = SLICE_MS) -> DataFrame:
    """Adds whether each point lies in an interval [start, end) of its key, by the greatest end among starts up to it."""
    row = F.struct(*[F.col(c) for c in points.columns])
    asked = points.select(key, F.col(at).alias("_at"), F.lit(None).cast("bigint").alias("_end"), row.alias("_row"))
    told = intervals.select(key, F.col(start).alias("_at"), F.col(end).alias("_end"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    usable = f"{key} is not null and _at is not null"
    seen = extreme(asked.unionByName(told).where(usable), [key], F.floor(F.col("_at") / slice_ms), "_at", F.col("_end"), "_reach", forward=False, strict=False, least=False)
    hit = seen.where("_row is not null").select("_row", F.coalesce(F.col("_reach") > F.col("_at"), F.lit(False)).alias(name))
    return hit.unionByName(asked.where(f"not ({usable})").select("_row", F.lit(False).alias(name))).select("_row.*", name)


def checkpoints(eps: DataFrame, durations: DataFrame, grid_ms: list[int], key: str = "session_id") -> DataFrame:
    """Causal checkpoints: grid points after each onset that come before the next onset (or the session's end)."""
    with_end = eps.join(durations.select(key, "duration_ms"), key)
    points = with_end.select(key, "episode", "onset_ms", "right_censored", F.coalesce("next_ms", "duration_ms").alias("until_ms"), F.explode(F.array(*[F.lit(g).cast("bigint") for g in grid_ms])).alias("elapsed_ms"))
    return points.withColumn("cutoff_ms", F.col("onset_ms") + F.col("elapsed_ms")).where("cutoff_ms < until_ms")


def classify_starts(turns: DataFrame, short_ms: int = 600, recent_ms: int = 250, slice_ms: int = SLICE_MS) -> DataFrame:
    """Event at the start of each interval: backchannel, barge_in, turn_shift or null.

    ``turns``: session_id, speaker, start_ms, end_ms (positive, none null). In this order: another speaker's interval
    covers the start: backchannel if this one is short, else barge_in; another speaker ended at most ``recent_ms`` ago
    and this one is short: backchannel; the interval with the latest end (then start) of those that start earlier is
    another speaker's: turn_shift. All of it follows from running maxima, so nothing is compared pair by pair.
    """
    rows = turns.select("session_id", "speaker", "start_ms", "end_ms")
    speakers = rows.select("session_id", F.col("speaker").alias("listener")).distinct()
    heard = rows.join(speakers, "session_id").where(F.col("speaker") != F.col("listener"))
    slot = F.floor(F.col("at") / slice_ms)
    namesakes = Window.partitionBy("session_id", "start_ms", "end_ms")  # of equal intervals the first name holds the floor
    named = rows.withColumn("_name", F.min("speaker").over(namesakes)).withColumnRenamed("start_ms", "at")
    holder = F.struct(F.col("end_ms"), F.col("at").alias("start_ms"), F.col("_name").alias("speaker"))
    with_floor = extreme(named, ["session_id"], slot, "at", holder, "floor", forward=False, strict=True, least=False)
    asked = with_floor.select("session_id", F.col("speaker").alias("listener"), "at", F.lit(None).cast("bigint").alias("other_end"), "end_ms", F.col("floor.speaker").alias("floor_speaker"), F.lit(True).alias("asks"))
    lanes = heard.select("session_id", "listener", F.col("start_ms").alias("at"), F.col("end_ms").alias("other_end")).unionByName(asked, allowMissingColumns=True)
    both = extreme(lanes, ["session_id", "listener"], slot, "at", F.col("other_end"), "reach", forward=False, strict=False, least=False).where("asks")
    both = both.select("session_id", F.col("listener").alias("speaker"), F.col("at").alias("start_ms"), "end_ms", "reach", "floor_speaker")
    short = F.col("end_ms") - F.col("start_ms") <= short_ms
    event = (
        F.when((F.col("reach") > F.col("start_ms")) & short, "backchannel")
        .when(F.col("reach") > F.col("start_ms"), "barge_in")
        .when((F.col("reach") >= F.col("start_ms") - recent_ms) & short, "backchannel")
        .when(F.col("floor_speaker") != F.col("speaker"), "turn_shift")
    )
    return both.select("session_id", "speaker", "start_ms", "end_ms", event.alias("kind"))


def interval_frames(df: DataFrame, keys: list[str], frame_ms: int, n_frames: Column | None = None) -> DataFrame:
    """Frames that intervals touch: floor(start) up to but not including ceil(end), each once."""
    last = F.ceil(F.col("end_ms") / frame_ms) - 1
    last = last if n_frames is None else F.least(last, n_frames - 1)
    first = F.greatest(F.floor(F.col("start_ms") / frame_ms), F.lit(0))
    spans = df.withColumn("_a", first).withColumn("_z", last).where("_a <= _z")
    return spans.select(*keys, F.explode(F.sequence("_a", "_z")).alias("frame")).distinct()

"""Frames of series: grids, crops, pooling, alignment, shifts, masks, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.running import placed

FRAME_MS = 80


def uniform_grid(sessions: DataFrame, frame_ms: int = FRAME_MS, duration: str = "duration_ms") -> DataFrame:
    """Frames 0 .. int(duration / frame) - 1 of each session with their start and end."""
    n = F.floor(F.col(duration) / frame_ms)
    each = sessions.where(n > 0).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return each.withColumn("t_start_ms", F.col("frame") * frame_ms).withColumn("t_end_ms", (F.col("frame") + 1) * frame_ms)


def crop(series: DataFrame, window_ms: int, mode: str, frame_ms: int = FRAME_MS, duration: str = "duration_ms") -> DataFrame:
    """The first or middle ``window_ms`` of each session's frames, renumbered from 0; shorter sessions give nothing."""
    start = F.lit(0) if mode == "first" else F.rint((F.col(duration) - window_ms) / 2 / frame_ms)
    n = window_ms // frame_ms
    kept = series.where(F.col(duration) >= window_ms).withColumn("frame", (F.col("frame") - start).cast("bigint"))
    return kept.where((F.col("frame") >= 0) & (F.col("frame") < n))


def too_short(sessions: DataFrame, window_ms: int, duration: str = "duration_ms") -> DataFrame:
    return sessions.where(F.col(duration) < window_ms)


def pool(series: DataFrame, keys: list[str], by: int = 4, value: str = "value") -> DataFrame:
    """Means of groups of ``by`` frames; a group that isn't whole is dropped."""
    g = series.groupBy(*keys, F.floor(F.col("frame") / by).alias("frame")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_n") == by).drop("_n")


def needs_pooling(n: Column, duration_ms: Column, from_hz: float = 50.0, to_hz: float = 12.5) -> Column:
    """Does the number of values fit the high rate better than the low one?"""
    s = duration_ms / 1000
    return F.abs(n - s * from_hz) < F.abs(n - s * to_hz)


def align(series: DataFrame, names: list[str], keys: list[str] | None = None, name: str = "signal_name") -> DataFrame:
    """Only frames that every one of the signals has. Counting replaces a chain of joins."""
    keys = keys or ["session_id"]
    wanted = series.where(F.col(name).isin(names))
    full = wanted.groupBy(*keys, "frame").agg(F.count_distinct(name).alias("_n")).where(F.col("_n") == len(names)).drop("_n")
    return wanted.join(full, [*keys, "frame"], "left_semi")


def wide(series: DataFrame, names: list[str], keys: list[str], value: str = "value", name: str = "signal_name") -> DataFrame:
    """One row per frame with a column per signal; only frames that have all."""
    cols = [F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    return series.where(F.col(name).isin(names)).groupBy(*keys, "frame").agg(*cols).dropna(subset=names)


def shifted(frames: DataFrame, keys: list[str], value: str, by: int, out: str = "target") -> DataFrame:
    """Each frame with the value ``by`` frames later; frames without one are dropped. An equi join, so any length spreads."""
    later = frames.select(*keys, (F.col("frame") - by).alias("frame"), F.col(value).alias(out))
    return frames.join(later, [*keys, "frame"])


#: Frames of a piece that a long series is cut into: ten minutes at 80 ms.
PIECE = 7_500


def islands(frames: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a number that consecutive frames of the keys share: the frame less its place among the frames."""
    order = placed(frames, keys, F.floor(F.col("frame") / PIECE), ["frame"], name)
    return order.withColumn(name, F.col("frame") - F.col(name))


def runs(frames: DataFrame, keys: list[str], on: str) -> DataFrame:
    """Runs of consecutive frames with equal ``on``: keys, on, first frame, number of frames."""
    marked = islands(frames, [*keys, on], "_island")
    return marked.groupBy(*keys, on, "_island").agg(F.min("frame").alias("frame"), F.count(F.lit(1)).alias("n_frames")).drop("_island")


def resample_nearest(values: Column, n: int) -> Column:
    """``n`` elements at evenly spread places of an array (first to last), places truncated."""
    last = F.size(values) - 1
    step = last / F.lit(max(n - 1, 1)).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, F.least((i * step).cast("int"), last)))


def resample_linear(values: Column, n: int) -> Column:
    """``n`` evenly spread values between the first and last element, linearly interpolated."""
    last = (F.size(values) - 1).cast("double")
    at = lambda i: i * last / F.lit(float(max(n - 1, 1)))

    def one(i: Column) -> Column:
        lo = F.floor(at(i)).cast("int")
        hi = F.least(lo + 1, F.size(values) - 1)
        return F.get(values, lo) + (F.get(values, hi) - F.get(values, lo)) * (at(i) - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def sliding_rms(values: Column, width: int, hop: int) -> Column:
    """Root mean square of windows of ``width`` elements every ``hop``; only whole windows."""
    n = F.floor((F.size(values) - width) / hop).cast("int") + 1
    root = lambda i: F.sqrt(F.aggregate(F.slice(values, i * hop + 1, F.lit(width)), F.lit(0.0), lambda a, x: a + x * x) / width)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), root)).otherwise(F.array().cast("array<double>"))


def sliding_frames(frames: DataFrame, keys: list[str], width: int, hop: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over windows of ``width`` frames every ``hop``, by ``place``; only windows that have all their frames.

    Each frame names the windows it belongs to, so windows are summed where they are and a long series spreads.
    """
    first = F.greatest(F.ceil((F.col("frame") - (width - 1)) / hop), F.lit(0))
    each = frames.withColumn("place", F.explode(F.sequence(first, F.floor(F.col("frame") / hop))))
    g = each.groupBy(*keys, "place").agg(*[a.alias(n) for n, a in aggs.items()], F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_n") == width).drop("_n")


def _spread(frames: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``n`` evenly spread places ``x`` from frame 0 to the last frame of each series."""
    last = frames.groupBy(*keys).agg(F.max("frame").alias("_last"))
    return last.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", F.col("i") * F.col("_last") / F.lit(float(max(n - 1, 1)))).drop("_last")


def resampled_nearest(frames: DataFrame, keys: list[str], n: int, value: str = "value") -> DataFrame:
    """Values at ``n`` places (truncated) of each series; null where the frame is missing."""
    last = frames.groupBy(*keys).agg(F.max("frame").alias("_last"))
    at = last.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("frame", (F.col("i") * (F.col("_last") / F.lit(float(max(n - 1, 1))))).cast("bigint"))
    return at.join(frames.select(*keys, "frame", value), [*keys, "frame"], "left").select(*keys, "i", value)


def resampled_linear(frames: DataFrame, keys: list[str], n: int, value: str = "value") -> DataFrame:
    """Linearly interpolated values at ``n`` places of each series; null where a neighbour is missing."""
    at = _spread(frames, keys, n).withColumn("_a", F.floor("x")).withColumn("_b", F.ceil("x"))
    side = lambda c: frames.select(*keys, F.col("frame").alias(c), F.col(value).alias(f"{c}v"))
    j = at.join(side("_a"), [*keys, "_a"], "left").join(side("_b"), [*keys, "_b"], "left")
    return j.select(*keys, "i", (F.col("_av") + (F.col("_bv") - F.col("_av")) * (F.col("x") - F.floor("x"))).alias(value))


def undelay(frames: DataFrame, keys: list[str], delay: Column, value: str = "value") -> DataFrame:
    """Moves each row back by its delay; frames in front are dropped, so the tail is missing (masked)."""
    moved = frames.withColumn("_to", F.col("frame") - delay).where("_to >= 0").select(*keys, F.col("_to").alias("frame"), F.col(value).alias("_moved"))
    return frames.join(moved, [*keys, "frame"], "left").withColumn(value, F.col("_moved")).drop("_moved")

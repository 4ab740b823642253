"""Seeded sessions for tests and demonstrations, made from hashes, so any cluster makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.columns import EVENT_KINDS, hash_share

FRAME_MS = 80


def uniform(seed: int, *parts: Column | str) -> Column:
    return hash_share(F.lit(seed), *parts)


def sessions(spark: SparkSession, n: int, duration_ms: int = 60_000) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("syn-"), "id").alias("session_id"), F.lit(duration_ms).cast("bigint").alias("duration_ms"))


def events(spark: SparkSession, n: int, duration_ms: int = 60_000, every_ms: int = 4_000, seed: int = 0) -> DataFrame:
    """One event in each stretch of ``every_ms``, of a kind and at a place that hashes choose."""
    s = sessions(spark, n, duration_ms).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(duration_ms // every_ms - 1))))
    kind = F.get(F.array(*[F.lit(k) for k in EVENT_KINDS]), F.floor(uniform(seed, "session_id", "k", F.lit("kind")) * len(EVENT_KINDS)).cast("int"))
    t = (F.col("k") * every_ms + F.floor(uniform(seed, "session_id", "k", F.lit("t")) * every_ms)).cast("bigint")
    return s.select("session_id", kind.alias("kind"), t.alias("t_ms"))


def salient_frames(spark: SparkSession, n: int, duration_ms: int = 60_000, every_ms: int = 4_000, noise: float = 0.2, seed: int = 0) -> DataFrame:
    """Frames whose value rises before each event, and a control that doesn't know the events."""
    from turnloom.operators.labels import salience
    from turnloom.operators.timeline import uniform_grid

    grid = uniform_grid(sessions(spark, n, duration_ms))
    seen = salience(grid, events(spark, n, duration_ms, every_ms, seed).select("session_id", "t_ms"), ["session_id"])
    hum = uniform(seed, "session_id", "frame", F.lit("noise")) * noise
    control = uniform(seed, "session_id", "frame", F.lit("control"))
    return seen.select("session_id", "frame", "t_end_ms", "duration_ms", (F.col("salience") + hum).alias("salience"), control.alias("random"))

"""Labels of frames by coming events, and which source of labels a session uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.arrays import decay
from turnloom.operators.running import extreme

SLICE_MS = 600_000


def next_event(frames: DataFrame, events: DataFrame, keys: list[str], at: str = "t_end_ms", slice_ms: int = SLICE_MS) -> DataFrame:
    """Adds ``next_ms``: time of the first event of the keys strictly after ``at``; null if none comes or a key is null.

    ``events``: keys, ``t_ms``. One pass over the merged timeline instead of comparing every frame with every event.
    """
    row = F.struct(*[F.col(c) for c in frames.columns])
    asked = frames.select(*keys, F.col(at).alias("_at"), F.lit(None).cast("bigint").alias("_event"), row.alias("_row"))
    told = events.select(*keys, F.col("t_ms").alias("_at"), F.col("t_ms").alias("_event"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    usable = " and ".join(f"{c} is not null" for c in [*keys, "_at"])
    seen = extreme(asked.unionByName(told).where(usable), keys, F.floor(F.col("_at") / slice_ms), "_at", F.col("_event"), "next_ms", forward=True, strict=True, least=True)
    out = seen.where("_row is not null").select("_row", "next_ms").unionByName(asked.where(f"not ({usable})").select("_row", F.lit(None).cast("bigint").alias("next_ms")))
    return out.select("_row.*", "next_ms")


def next_within(frames: DataFrame, marks: DataFrame, keys: list[str], kinds: dict[str, str], reach_ms: int, at: str = "t_end_ms", slice_ms: int = SLICE_MS) -> DataFrame:
    """Adds a column for each of ``kinds`` (column: kind): time of the first mark of that kind in (at, at + reach_ms], else null.

    ``marks``: keys, ``kind``, ``t_ms``. Sessions are cut into slices of time; a mark goes to the slices whose frames it
    can be near to, so one window over (keys, slice) answers for all kinds at once and no slice needs another one. Rows
    with a null key or time get nulls.
    """
    usable = " and ".join(f"{c} is not null" for c in [*keys, at])
    slot = F.when(F.expr(usable), F.floor(F.col(at) / slice_ms)).otherwise(F.spark_partition_id())
    asked = frames.withColumn("_slot", slot).withColumn("_at", F.col(at)).withColumn("_kind", F.lit(None).cast("string"))
    told = marks.where(" and ".join(f"{c} is not null" for c in [*keys, "t_ms"])).select(
        *keys, F.explode(F.sequence(F.floor((F.col("t_ms") - reach_ms) / slice_ms), F.floor((F.col("t_ms") - 1) / slice_ms))).alias("_slot"), F.col("t_ms").alias("_at"), F.col("kind").alias("_kind")
    )
    w = Window.partitionBy(*keys, "_slot").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    seen = asked.unionByName(told, allowMissingColumns=True)
    found = {name: F.min(F.when(F.col("_kind") == kind, F.col("_at"))).over(w) for name, kind in kinds.items()}
    near = seen.select(*frames.columns, "_kind", "_at", *[c.alias(f"_next_{n}") for n, c in found.items()]).where("_kind is null")
    return near.select(*frames.columns, *[F.when(F.col(f"_next_{n}") <= F.col("_at") + reach_ms, F.col(f"_next_{n}")).alias(n) for n in found])


def horizon_flags(frames: DataFrame, events: DataFrame, kinds: list[str], horizons_ms: list[int], ends: DataFrame | None = None, duration: str = "duration_ms") -> DataFrame:
    """A row per frame with a label for each kind and horizon h in ``y0``, ``y1``, ... (horizons of the first kind first).

    1 iff an event of the kind falls in (t_end, t_end + h], else 0; null where t_end + h exceeds the session's length: that
    of ``ends`` (session_id, duration_ms), of which a mark on the timeline tells, or else of the column ``duration``. Kinds
    and horizons are columns instead of rows, so whatever ranks the frames ranks them once for all.
    """
    reach = max(horizons_ms) + 1
    names = {f"_e{i}": k for i, k in enumerate(kinds)}
    marks = events.select("session_id", "kind", "t_ms")
    if ends is not None:
        marks = marks.unionByName(ends.select("session_id", F.lit("\x00end").alias("kind"), (F.col("duration_ms") + 1).alias("t_ms")))
        names["_end"] = "\x00end"
    seen = next_within(frames, marks, ["session_id"], names, reach)
    ys = []
    for i in range(len(kinds)):
        for h in horizons_ms:
            until = F.col("t_end_ms") + h
            inside = F.coalesce(until < F.col("_end"), F.lit(True)) if ends is not None else until <= F.col(duration)
            ys.append(F.when(inside, F.coalesce((F.col(f"_e{i}") <= until).cast("int"), F.lit(0))).alias(f"y{len(ys)}"))
    return seen.select(*frames.columns, *ys)


def flag_names(kinds: list[str], horizons_ms: list[int]) -> list[tuple[str, int]]:
    """Kind and horizon of ``y0``, ``y1``, ..."""
    return [(k, h) for k in kinds for h in horizons_ms]


def named_flags(df: DataFrame, kinds: list[str], horizons_ms: list[int], which: str = "which") -> DataFrame:
    """``which`` (the number of a label column) as ``kind`` and ``horizon_ms``."""
    names = flag_names(kinds, horizons_ms)
    pick = lambda values: F.get(F.array(*values), F.col(which))
    return df.withColumn("kind", pick([F.lit(k) for k, _ in names])).withColumn("horizon_ms", pick([F.lit(h).cast("bigint") for _, h in names])).drop(which)


def horizon_labels(frames: DataFrame, events: DataFrame, kinds: list[str], horizons_ms: list[int], duration: str = "duration_ms") -> DataFrame:
    """A row per frame, kind and horizon h with t_end + h <= duration: ``y`` is 1 iff an event falls in (t_end, t_end + h].

    ``frames``: session_id, t_end_ms, the duration column and whatever else; ``events``: session_id, kind, t_ms.
    """
    flags = horizon_flags(frames, events, kinds, horizons_ms, None, duration)
    n = len(kinds) * len(horizons_ms)
    long = flags.select(*frames.columns, F.posexplode(F.array(*[f"y{i}" for i in range(n)])).alias("which", "y")).where("y is not null")
    return named_flags(long, kinds, horizons_ms).select(*frames.columns, "kind", "horizon_ms", "y")


def salience(frames: DataFrame, events: DataFrame, keys: list[str], reach_ms: int = 2000, rate_ms: float = 600.0) -> DataFrame:
    """Adds ``salience``: exp(-gap / rate) to the next event if it comes within reach, else 0."""
    seen = next_within(frames, events.withColumn("kind", F.lit("any")), keys, {"next_ms": "any"}, reach_ms)
    gap = F.col("next_ms") - F.col("t_end_ms")
    return seen.withColumn("salience", F.coalesce(decay(gap, rate_ms), F.lit(0.0)))


def by_precedence(sources: list[DataFrame], key: str = "session_id") -> DataFrame:
    """Rows of the first source in the list that has the session at all, with the source's ``priority``."""
    tagged = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(sources)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    first = every.groupBy(key).agg(F.min("priority").alias("_first"))
    return every.join(first, key).where(F.col("priority") == F.col("_first")).drop("_first")


def grid(df: DataFrame, kinds: list[str], horizons: list) -> DataFrame:
    """Every row with every kind and horizon."""
    return df.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))


def rebased(events: DataFrame, start: Column, length: int) -> DataFrame:
    """Events inside [start, start + length), with times from the start."""
    shifted = events.withColumn("t_ms", F.col("t_ms") - start)
    return shifted.where((F.col("t_ms") >= 0) & (F.col("t_ms") < length))

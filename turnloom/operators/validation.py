"""Constraints as queries: each gives the rows that break it, so an empty result means the data is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def broken_dependencies(df: DataFrame, key: str, dependents: list[str]) -> DataFrame:
    """Keys with more than one value (null counts as one) of a column that they should determine."""
    values = [F.count_distinct(F.coalesce(F.col(d).cast("string"), F.lit("\u0000"))).alias(d) for d in dependents]
    return df.groupBy(key).agg(*values).where(reduce(lambda a, b: a | b, [F.col(d) > 1 for d in dependents]))


def wrong_counts(df: DataFrame, key: str, least: int, most: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(least, most))


def rule_breaks(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row per broken rule: keys and the rule's name. A rule that gives null is broken."""
    named = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(*keys, F.explode(F.array_compact(named)).alias("rule"))


def broken_intervals(df: DataFrame, key: str, start: str, end: str, duration: str | None = None) -> DataFrame:
    """Intervals that are empty, out of the session or start before their predecessor ends."""
    w = Window.partitionBy(key).orderBy(start, end)
    prev = F.lag(end).over(w)
    why = F.when(F.col(end) <= F.col(start), "empty")
    if duration:
        why = why.when((F.col(start) < 0) | (F.col(end) > F.col(duration)), "out of range")
    why = why.when(prev > F.col(start), "overlaps")
    return df.withColumn("reason", why).where("reason is not null").select(key, start, end, "reason")


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are on one side only: 'missing' on the right, 'unexpected' on the left."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys on both sides whose attributes differ (null equals null), with the first differing column."""
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    first = F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns])
    return left.join(r, keys).withColumn("column", first).where("column is not null").select(*keys, "column")


def differing_fields(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unknown) columns against an exact set."""
    return sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))

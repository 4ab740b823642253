"""Samples that match target shares of categories, by the cube method.

Inclusion probabilities are kept as whole numerators over the number of candidates of the category, so the flight phase
on the category indicators is exact: a step moves two records of one category along the only direction that leaves the
category's sum alone, until one of them reaches 0 or 1. A partition is flown batch by batch and leaves at most one
unresolved record per category; these merge upward, level by level, and the landing resolves what remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.runtime import spill

#: Into how many shares a group is cut before its first records are ranked.
SHARES = 64

STATE = "category bigint, id bigint, mass bigint, whole bigint"


def _draw(seed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A uniform number for each pair of ids: the same whenever a lost task runs again."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(33)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def fly(category: np.ndarray, ids: np.ndarray, mass: np.ndarray, whole: np.ndarray, seed: int) -> np.ndarray:
    """Masses after the flight phase: 0 or ``whole`` but for at most one record per category; category sums stay.

    All pairs of neighbouring unresolved records of a category take their step at once; at least one of each pair is
    resolved, so the rounds are as many as the logarithm of the records.
    """
    mass = mass.copy()
    for turn in range(200):
        free = np.flatnonzero((mass > 0) & (mass < whole))
        free = free[np.lexsort((ids[free], category[free]))]
        c = category[free]
        if len(free) < 2:
            break
        opens = np.concatenate([[True], c[1:] != c[:-1]])
        place = np.arange(len(c)) - np.maximum.accumulate(np.where(opens, np.arange(len(c)), 0))
        at = np.flatnonzero((place[:-1] % 2 == 0) & (c[1:] == c[:-1]))
        if not len(at):
            break
        a, b = free[at], free[at + 1]
        total, size = mass[a] + mass[b], whole[a]
        u = _draw(seed * 1000 + turn, ids[a], ids[b])
        low = total <= size  # one falls to 0, the other takes both; else one rises to 1, the other keeps the rest
        to_a = np.where(low, u * total < mass[a], u * (2 * size - total) < size - mass[b])
        top, rest = np.where(low, total, size), np.where(low, 0, total - size)
        mass[a], mass[b] = np.where(to_a, top, rest), np.where(to_a, rest, top)
    return mass


def _flight(seed: int):
    """Settled records leave at once; unresolved ones (one per category at most) wait for the next batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: pd.DataFrame | None = None
        for frame in frames:
            both = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            both["mass"] = fly(*(both[c].to_numpy() for c in ("category", "id", "mass", "whole")), seed)
            free = (both.mass > 0) & (both.mass < both.whole)
            yield both[(both.mass > 0) & ~free]  # those at 0 are out of the sample
            waiting = both[free]
        if waiting is not None:
            yield waiting

    return run


def cube_sample(units: DataFrame, seed: int = 7, fan_in: int = 32) -> DataFrame:
    """Ids of a balanced sample. ``units``: category, id, mass, whole (all bigint; mass / whole is the inclusion probability).

    ``whole`` must be the same for all units of a category. If the masses of a category add up to a multiple of
    ``whole``, exactly that many of its units are taken; else the landing rounds the last unit up or down by its
    probability. Ids must be unique. No units give an empty sample. Result: category, id.
    """
    units = spill(units.select(*[F.col(c).cast("bigint").alias(c) for c in ("category", "id", "mass", "whole")]).where("mass > 0 and whole > 0"), "units")
    level, settled = 0, None
    parts = max(1, units.rdd.getNumPartitions())
    current = units
    while True:
        flown = spill(current.mapInPandas(_flight(seed * 100 + level), STATE), "flown")
        taken = flown.where("mass = whole").select("category", "id")
        settled = taken if settled is None else settled.unionByName(taken)
        if parts == 1:
            break
        parts = -(-parts // fan_in)
        level += 1
        current = spill(flown.where("mass < whole").repartition(parts, "category") if parts > 1 else flown.where("mass < whole").coalesce(1), "merged")
    left = flown.where("mass < whole")  # the landing: at most one per category, only where masses add up to a fraction
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return settled.unionByName(left.where(u < F.col("mass") / F.col("whole")).select("category", "id"))


def balanced_sample(
    rows: DataFrame, targets: DataFrame, category: list[str], id_col: str, group: str, size_div: int = 10, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for target shares with minimum counts and a cap per group.

    ``rows``: one row per usable record with the category columns, ``id_col`` (whole number) and ``group``; a repeated
    id counts once, by its smallest category and group. ``targets``: the category columns, ``target_bp``, ``min_rows``
    and ``lineage_cap``; rows of other categories count for the size but can't be sampled. Wanted is
    max(min_rows, target_bp * S div 10000) with S = records div ``size_div``; candidates are at most ``lineage_cap``
    records of each group, in the order of a hash. Rows with a null in id, category or group are left out. Other
    columns are dropped. No rows: an empty sample and a report of what is missing.
    Sample: category columns, id_col, group. Report: category columns, target_bp, wanted, available, taken, residual,
    target_share (of the targets) and actual_share (of the sample; null if it is empty). Each category's total is kept
    exactly, so every margin (a source, a stratum) is balanced as well: see ``margins``.
    """
    one = rows.select(F.col(id_col).cast("bigint").alias("id"), *category, F.col(group).alias("grp")).dropna()
    one = one.groupBy("id").agg(F.min(F.struct(*category, "grp")).alias("r")).select("id", "r.*")
    one = spill(one, "usable")
    size = one.count() // size_div
    goals = targets.select(*category, "target_bp", "min_rows", "lineage_cap").dropna()
    goals = goals.withColumn("wanted", F.greatest(F.col("min_rows").cast("bigint"), F.expr(f"(target_bp * bigint({size})) div 10000")))
    goals = goals.withColumn("category", F.row_number().over(Window.orderBy(*category)).cast("bigint"))  # targets are a small fixed table
    # the first of each group in the order of a hash: of every share of a group first, so that a large one is ranked by many tasks
    in_goal = one.join(goals.select(*category, "category", "lineage_cap", "wanted"), category).withColumn("h", F.xxhash64("id", F.lit(seed)))
    in_goal = in_goal.withColumn("share", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(SHARES)))
    for by in (["category", "grp", "share"], ["category", "grp"]):
        in_goal = in_goal.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))).where("n <= lineage_cap")
    candidates = spill(in_goal.select("category", "id", "wanted"), "candidates")
    available = candidates.groupBy("category").agg(F.count(F.lit(1)).alias("available"))
    units = candidates.join(available, "category").select("category", "id", F.least("wanted", "available").alias("mass"), F.col("available").alias("whole"))
    sample = spill(cube_sample(units, seed), "sample")
    taken = sample.groupBy("category").agg(F.count(F.lit(1)).alias("taken"))
    report = goals.join(available, "category", "left").join(taken, "category", "left")
    report = report.select(*category, "target_bp", "wanted", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available", "taken")])
    report = report.withColumn("residual", F.col("taken") - F.col("wanted"))
    sums = report.agg(F.sum("target_bp").alias("_bp"), F.sum("taken").alias("_taken"))
    report = report.crossJoin(sums).withColumn("target_share", F.try_divide("target_bp", "_bp")).withColumn("actual_share", F.try_divide("taken", "_taken")).drop("_bp", "_taken")  # one row
    picked = one.join(sample.select("id"), "id").select(*category, F.col("id").alias(id_col), F.col("grp").alias(group))
    return picked, report


def margins(report: DataFrame, category: list[str]) -> DataFrame:
    """The report's counts and shares by each category column alone: margin, value, wanted, available, taken, residual, target_share, actual_share."""
    out = None
    for c in category:
        sums = [F.sum(x).alias(x) for x in ("wanted", "available", "taken", "residual", "target_share", "actual_share")]
        part = report.groupBy(F.lit(c).alias("margin"), F.col(c).cast("string").alias("value")).agg(*sums)
        out = part if out is None else out.unionByName(part)
    return out


def stratum(c: Column | str) -> Column:
    """Elapsed time as the targets name it."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x < 1, "<1s").when(x < 3, "1-<3s").otherwise(">=3s")

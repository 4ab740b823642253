"""Containers of fixed capacity, by sum-of-squares packing.

``N(g)`` is the number of open bins with gap g. Each item goes where the sum of N(g)^2 becomes smallest, which keeps
every gap about equally rare and so avoids gaps that no later item fits. Partitions pack their own items; the bins they
leave open merge upward as items of their own, so the waste doesn't grow with the number of partitions. A level has as many
runs as its open bins need, and the levels end with a single run or where bins no longer combine, so no task packs more
than its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.runtime import drop, spill

#: Records that one task packs; the tables are split so that no task gets many more.
TASK_ROWS = 20_000
#: Share of the open bins that a level has to close or join; below it they are too full to be combined with each other.
LEAST_GAIN = 0.05


class SumOfSquares:
    """Online packer: ``place(size)`` gives the number of the bin that takes the item."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # N(g); N(0) stays 0: full bins don't count
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        n, b = self.open, self.capacity
        # half the change of the sum, without the constant: one bin of gap g less, one of gap g - size more
        change = np.where(n[size:] > 0, n[: b - size + 1] - n[size:], np.iinfo(np.int32).max)
        change[0] = np.iinfo(np.int32).max
        best = int(change.argmin())
        options = [(2 * int(change[best]) + 2, best)]
        if n[size]:
            options.append((1 - 2 * int(n[size]), 0))  # fills a bin: no new gap to pay for
        options.append((2 * int(n[b - size]) + 1, -1))  # a new bin
        gap = min(options)[1]
        if gap < 0:
            number, gap = self.made, b - size
            self.made += 1
        else:
            n[gap + size] -= 1
            number = self.bins[gap + size].pop()
        if gap:
            n[gap] += 1
            self.bins[gap].append(number)
        return number


def _pack(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer: SumOfSquares | None = None
        part = None
        for frame in frames:
            bins = np.empty(len(frame), np.int64)
            parts, sizes = frame["part"].to_numpy(), frame["size"].to_numpy()
            for i in range(len(frame)):
                if parts[i] != part:
                    packer, part = SumOfSquares(capacity), parts[i]
                bins[i] = packer.place(int(sizes[i]))
            yield pd.DataFrame({"part": parts, "item": frame["item"], "piece": frame["piece"], "size": sizes, "bin": bins})

    return run


def _level(items: DataFrame, capacity: int, parts: int, seed: int, name: str) -> DataFrame:
    """Packs (item, piece, size) in ``parts`` independent runs; adds part and bin. Order within a run is that of a hash."""
    kind = dict(items.dtypes)["item"]
    placed = items.withColumn("h", F.xxhash64("item", "piece", F.lit(seed))).withColumn("part", F.pmod("h", F.lit(parts)).cast("bigint"))
    lined = placed.repartition(min(parts, 4096), "part").sortWithinPartitions("part", "h", "item", "piece")
    done = lined.select("part", "item", "piece", "size").mapInPandas(_pack(capacity), f"part bigint, item {kind}, piece bigint, size bigint, bin bigint")
    return spill(done, name)


def pack(items: DataFrame, capacity: int = 2048, task_rows: int = TASK_ROWS, seed: int = 5) -> DataFrame:
    """Container of each piece of each item: (item, piece, size, container).

    ``items``: item (a whole number, unique), size (a whole number). Only items above the capacity are split: into full
    containers and one remainder. Items of size 0, null or less need no container and get null. Rows with a null item
    are left out; other columns are ignored. Container ids are strings, unique in the result. No items: no rows.
    """
    given = items.select(F.col("item").cast("bigint").alias("item"), F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size")).where("item is not null")
    given = spill(given, "items")
    none = given.where("size <= 0").select("item", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("container"))
    cuts = f"if(size > {capacity}, sequence(0L, (size - 1) div {capacity}), array(0L))"
    pieces = given.where("size > 0").select("item", F.explode(F.expr(cuts)).alias("piece"), F.col("size").alias("total"))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("bigint"), F.col("total") - F.col("piece") * capacity))
    full = pieces.where(F.col("size") == capacity).select("item", "piece", "size", F.concat_ws("-", F.lit("full"), "item", "piece").alias("container"))
    loose = pieces.where(F.col("size") < capacity).select("item", "piece", "size")
    n = given.where(f"size > 0 and size % {capacity} <> 0").count()
    parts = max(1, -(-n // task_rows))
    packed = _level(loose, capacity, parts, seed, "packed")
    named = packed.withColumn("container", F.concat_ws("-", F.lit("L0"), "part", "bin"))
    open_bins = named.groupBy("container").agg(F.sum("size").alias("size")).where(F.col("size") < capacity)
    open_bins = spill(open_bins.select("container", F.col("container").alias("now"), "size"), "bins")
    level, left = 0, open_bins.count() if parts > 1 else 0
    while parts > 1 and left > 1:  # open bins are the items of the next level, in runs of at most about task_rows
        level += 1
        parts = max(1, -(-left // task_rows))
        fill = open_bins.groupBy(F.col("now").alias("item")).agg(F.sum("size").alias("size")).where(F.col("size") < capacity)
        merged = _level(fill.select("item", F.lit(0).cast("bigint").alias("piece"), "size"), capacity, parts, seed + level, "merged")
        into = merged.select(F.col("item").alias("now"), F.concat_ws("-", F.lit(f"L{level}"), "part", "bin").alias("into"))
        after = spill(open_bins.join(into, "now", "left").select("container", F.coalesce("into", "now").alias("now"), "size"), "bins")
        drop(open_bins)
        open_bins = after
        still = open_bins.groupBy("now").agg(F.sum("size").alias("size")).where(F.col("size") < capacity).count()
        if parts == 1 or still > left * (1 - LEAST_GAIN):
            break  # what is left fits nothing else: another level would only move it
        left = still
    if level:
        named = named.join(open_bins.select("container", "now"), "container", "left").withColumn("container", F.coalesce("now", "container"))
    return none.unionByName(full).unionByName(named.select("item", "piece", "size", "container"))

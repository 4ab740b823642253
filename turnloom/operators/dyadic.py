"""Continuous periods and gaps of time intervals, by dyadic blocks.

Each interval ``[from, to)`` in whole milliseconds is the disjoint union of canonical dyadic blocks
``[i * 2^k, (i + 1) * 2^k)``, and every block lies in exactly one cell of ``2^TOP`` ms. Map tasks decompose their
intervals, drop blocks that an ancestor covers and merge sibling pairs upward before anything is shuffled, so however
many intervals overlap in a cell, a task sends at most the blocks of their union. Cells are then merged the same way,
spread by key and cell: a key with a third of all rows is worked on by as many tasks as it has cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.runtime import spill

#: Level of the largest block: 2^20 ms, about 17 minutes; more where intervals are so long that they would be many blocks.
TOP, HIGHEST, MOST_BLOCKS = 20, 36, 1 << 10


#: Intervals that a map task merges at once, and blocks of one cell beyond which the cell is merged while it is read.
FLUSH, CROWDED = 100_000, 1 << 22


def dyadic_blocks(lo: np.ndarray, hi: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(interval, code) of all canonical blocks of the intervals; a code is start * 64 + 63 - level.

    So codes sort by start, larger blocks first. Level k takes part iff ceil(lo / 2^k) < floor(hi / 2^k): the left end
    if odd, the block before the right end if that end is odd. At the top level all whole blocks count.
    """
    where, codes = [], []
    at = np.flatnonzero(lo < hi)
    for k in range(top):
        up, down = -((-lo[at]) >> k), hi[at] >> k
        left, right = (up < down) & (up & 1 == 1), (up < down) & (down & 1 == 1)
        where += [at[left], at[right]]
        codes += [(up[left] << (k + 6)) + 63 - k, ((down[right] - 1) << (k + 6)) + 63 - k]
        at = at[up < down]
    up, down = -((-lo[at]) >> top), hi[at] >> top
    many = np.maximum(down - up, 0)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    where.append(np.repeat(at, many))
    codes.append(((np.repeat(up, many) + step) << (top + 6)) + 63 - top)
    return np.concatenate(where), np.concatenate(codes)


def _merged(group: np.ndarray, start: np.ndarray, level: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, level) of blocks without those that an ancestor or a copy covers, sibling pairs merged upward.

    Input: sorted by group (one cell of one key), start and falling level.
    """
    end = start + (np.int64(1) << level)
    reach = group * np.int64(1 << (top + 2)) + (end - ((start >> top) << top))
    before = np.maximum.accumulate(reach)
    keep = np.ones(len(group), bool)
    keep[1:] = before[:-1] < reach[1:]
    row = np.flatnonzero(keep)
    group, start, level = group[keep], start[keep], level[keep].copy()
    for k in range(top):
        if len(level) < 2:
            break
        left = (level[:-1] == k) & (level[1:] == k) & (group[:-1] == group[1:])
        left &= ((start[:-1] >> k) & 1 == 0) & (start[1:] - start[:-1] == 1 << k)
        at = np.flatnonzero(left)
        if len(at):
            level[at] += 1
            stay = np.ones(len(level), bool)
            stay[at + 1] = False
            row, group, start, level = row[stay], group[stay], start[stay], level[stay]
    return row, start, level


def _codes_of(block: pa.RecordBatch, width: int) -> np.ndarray:
    """A number for each row by its first ``width`` columns: equal rows, equal numbers."""
    import pyarrow.compute as pc

    out = np.zeros(block.num_rows, np.int64)
    for i in range(width):
        c = pc.dictionary_encode(block.column(i))
        out = np.unique(out * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
    return out


def _decompose(width: int, top: int):
    """Arrow function of a map task: intervals (keys, lo, hi) in, merged blocks (keys, b) out."""

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = _join(batches)
        where, code = dyadic_blocks(block.column(width).to_numpy(), block.column(width + 1).to_numpy(), top)
        key = _codes_of(block, width)[where]
        order = np.lexsort((code, key))
        where, code, key = where[order], code[order], key[order]
        cell = code >> (top + 6)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])).astype(np.int64)[: len(code)]
        row, start, level = _merged(group, code >> 6, 63 - (code & 63), top)
        rows = pa.array(where[row])
        columns = [block.column(i).take(rows) for i in range(width)]
        return pa.RecordBatch.from_arrays([*columns, pa.array((start << 6) + 63 - level, pa.int64())], names=[*block.schema.names[:width], "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= FLUSH:
                yield flush(waiting)
                waiting, n = [], 0
        if n:
            yield flush(waiting)

    return run


def _cells(width: int, top: int):
    """Arrow function: blocks (keys, b, h) sorted by h and b in; out the runs, inner gaps, border runs and outline of
    every cell. ``h`` is a hash of keys and cell, so cells lie together; two cells that share it are told apart."""

    def ordered(block: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """The rows cell by cell, with the number of the cell and the code."""
        h, code = block.column(width + 1).to_numpy(), block.column(width).to_numpy()
        key, cell = _codes_of(block, width), code >> (top + 6)
        fresh = np.concatenate([[True], (h[1:] != h[:-1])])
        other = np.concatenate([[False], ~fresh[1:] & ((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))])
        if other.any():
            order = np.lexsort((code, cell, key, h))
            block, h, code, key, cell = block.take(pa.array(order)), h[order], code[order], key[order], cell[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        return block, np.cumsum(fresh).astype(np.int64), code

    def emit(block: pa.RecordBatch) -> pa.RecordBatch:
        block, group, code = ordered(block)
        row, start, level = _merged(group, code >> 6, 63 - (code & 63), top)
        g, cell, end = group[row], start >> top, start + (np.int64(1) << level)
        opens = np.ones(len(start), bool)
        opens[1:] = (g[1:] != g[:-1]) | (start[1:] != end[:-1])
        at = np.flatnonzero(opens)
        row, lo, hi, g, cell = row[at], start[at], end[np.append(at[1:], len(end)) - 1], g[at], cell[at]
        at_border = (lo == cell << top) | (hi == (cell + 1) << top)
        same = g[1:] == g[:-1]
        first, last = np.ones(len(g), bool), np.ones(len(g), bool)
        first[1:], last[:-1] = ~same, ~same
        inner = np.flatnonzero(same)
        parts = [
            ("period", row[~at_border], lo[~at_border], hi[~at_border]),
            ("edge", row[at_border], lo[at_border], hi[at_border]),
            ("gap", row[inner], hi[inner], lo[inner + 1]),
            ("cell", row[first], lo[first], hi[last]),
        ]
        rows = pa.array(np.concatenate([p[1] for p in parts]))
        columns = [block.column(i).take(rows) for i in range(width)]
        names = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(4, dtype=np.int32), [len(p[1]) for p in parts])), [p[0] for p in parts])
        columns.append(names.cast(pa.string()))
        columns += [pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in (2, 3)]
        return pa.RecordBatch.from_arrays(columns, names=[*block.schema.names[:width], "piece", "from_ms", "to_ms"])

    def thinned(block: pa.RecordBatch) -> pa.RecordBatch:
        """The same cells with fewer blocks."""
        block, group, code = ordered(block)
        row, start, level = _merged(group, code >> 6, 63 - (code & 63), top)
        block = block.take(pa.array(row))
        columns = [*block.columns[:width], pa.array((start << 6) + 63 - level, pa.int64()), block.column(width + 1)]
        return pa.RecordBatch.from_arrays(columns, names=block.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # the last cell, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if waiting is None else _join([waiting, batch])
            h = whole.column(width + 1).to_numpy()
            turns = np.flatnonzero(h[1:] != h[:-1])
            cut = int(turns[-1]) + 1 if len(turns) else 0
            if cut:
                yield emit(whole.slice(0, cut))
            waiting = whole.slice(cut)
            if waiting.num_rows > CROWDED:
                waiting = thinned(waiting)
        if waiting is not None:
            yield emit(waiting)

    return run


def _join(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def top_level(longest: int | None) -> int:
    """Level of the largest block: the longest interval then has about ``MOST_BLOCKS`` of them at most."""
    return min(HIGHEST, max(TOP, (int(longest or 0) // MOST_BLOCKS).bit_length()))


def periods_and_gaps(intervals: DataFrame, keys: list[str], lo: str = "from_ms", hi: str = "to_ms", top: int | None = None) -> DataFrame:
    """Continuous periods of the intervals of each key, and the gaps between two successive periods.

    ``lo`` and ``hi`` are whole numbers. Touching intervals are continuous; repeated, nested and overlapping ones
    count once. Rows with a null key or bound, or with ``hi <= lo``, are left out; an empty input gives no rows. Other
    columns are ignored. Result: the keys, ``piece`` ('period' or 'gap'), ``from_ms``, ``to_ms``. The level of the largest
    block follows from the longest interval if it isn't given; the result doesn't depend on it.
    """
    given = intervals.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi"))
    names = [f"k{i}" for i in range(len(keys))]
    keyed = ", ".join(f"{n} string" for n in names)
    given = given.dropna().where("lo < hi")
    top = top_level(given.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]) if top is None else top
    blocks = given.mapInArrow(_decompose(len(names), top), f"{keyed}, b bigint")
    placed = blocks.withColumn("h", F.xxhash64(*names, F.expr(f"shiftright(b, {top + 6})")))
    ordered = placed.repartition("h").sortWithinPartitions("h", "b")
    pieces = spill(ordered.mapInArrow(_cells(len(names), top), f"{keyed}, piece string, from_ms bigint, to_ms bigint"), "cells")

    by_key = Window.partitionBy(*names).orderBy("from_ms", "to_ms")
    border = pieces.where("piece = 'edge'").withColumn("opens", F.coalesce((F.lag("to_ms").over(by_key) < F.col("from_ms")).cast("int"), F.lit(1)))
    border = border.withColumn("island", F.sum("opens").over(by_key)).groupBy(*names, "island").agg(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"))
    between = pieces.where("piece = 'cell'").select(*names, F.lag("to_ms").over(by_key).alias("a"), F.col("from_ms").alias("b")).where("a < b")
    out = pieces.where("piece in ('period', 'gap')").unionByName(border.select(*names, F.lit("period").alias("piece"), "from_ms", "to_ms"))
    out = out.unionByName(between.select(*names, F.lit("gap").alias("piece"), F.col("a").alias("from_ms"), F.col("b").alias("to_ms")))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "piece", "from_ms", "to_ms")

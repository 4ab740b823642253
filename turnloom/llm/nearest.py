"""Nearest record in time within a tolerance, by a two-pointer merge of sorted streams.

Both tables are repartitioned by entity and slice of time, so an entity with a third of all rows is spread over its
slices; right records close to a slice's border are sent to both sides of it. Each partition is sorted by time and read
once as a stream of Arrow batches; between two batches only those records wait that lie within two tolerances of the
newest time, so memory doesn't depend on the size of an entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.columns import finite

SCHEMA = "left_id bigint, right_id bigint, series string, distance double"


def _match(entity: np.ndarray, t: np.ndarray, is_left: np.ndarray, series: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left records and of their nearest right record, for every series of the entity.

    Input sorted by entity, t, right before left, id: nothing is sorted again. Of each series one pointer goes along the
    merged stream; what it has passed last and what it comes to next are the two neighbours of a left record.
    """
    left = np.flatnonzero(is_left)
    who, best = [left[:0]], [left[:0]]
    for s in np.unique(series[~is_left]) if len(left) else []:
        mine = ~is_left & (series == s)
        right = np.flatnonzero(mine)
        pointer = np.cumsum(mine)[left]  # right records of the series up to each left record
        opens = np.ones(len(right), bool)  # the first of several right records at one time stands for them
        opens[1:] = (entity[right[1:]] != entity[right[:-1]]) | (t[right[1:]] != t[right[:-1]])
        stand_in = np.maximum.accumulate(np.where(opens, np.arange(len(right)), 0))
        found, gap = np.full(len(left), -1), np.full(len(left), np.inf)
        for neighbour in (pointer - 1, pointer):  # the earlier one first: it wins a tie
            ok = (neighbour >= 0) & (neighbour < len(right))
            r = right[stand_in[np.where(ok, neighbour, 0)]]
            d = np.abs(t[r] - t[left])
            better = ok & (entity[r] == entity[left]) & (d <= tolerance) & (d < gap)
            found[better], gap[better] = r[better], d[better]
        ok = found >= 0
        who.append(left[ok])
        best.append(found[ok])
    return np.concatenate(who), np.concatenate(best)


def _merge(tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch]).filter(pc.and_(pc.is_valid(batch["entity"]), pc.is_valid(batch["t"])))
            if part.num_rows:
                waiting = part if waiting is None else pa.concat_tables([waiting, part])
                out, waiting = step(waiting, False)
                yield from out
        if waiting is not None and waiting.num_rows:
            yield from step(waiting, True)[0]

    def step(rows: pa.Table, over: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        rows = rows.combine_chunks()
        t, slot = rows["t"].to_numpy(), rows["slot"].to_numpy()
        is_left = rows["is_left"].to_numpy()
        ids = rows["id"].to_numpy()
        names = rows["entity"]
        fresh = np.ones(len(t), bool)
        if len(t) > 1:
            fresh[1:] = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy() | (slot[1:] != slot[:-1])
        entity = np.cumsum(fresh) - 1
        codes = pc.dictionary_encode(pc.fill_null(rows["series"], "")).combine_chunks()
        series = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        left, right = _match(entity, t, is_left, series, tolerance)
        open_ = np.zeros(len(t), bool)
        keep = np.zeros(len(t), bool)
        if not over:  # the last entity may go on: left records that a coming right record may reach are not settled
            last = entity == entity[-1]
            open_ = last & (t >= t[-1] - tolerance)
            keep = last & (t >= t[-1] - 2 * tolerance) & (~is_left | open_)
        done = ~open_[left]
        left, right = left[done], right[done]
        pair, first = np.unique(np.stack([ids[left], series[right]], 1), axis=0, return_index=True)  # redelivered records are neighbours
        left, right = left[first], right[first]
        out = []
        if len(left):
            columns = [pa.array(ids[left]), pa.array(ids[right]), rows["series"].take(pa.array(right)).combine_chunks(), pa.array(np.abs(t[right] - t[left]))]
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else c.combine_chunks() for c in columns], names=["left_id", "right_id", "series", "distance"]))
        return out, rows.filter(pa.array(keep))

    return run


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float, slice_s: float = 60.0) -> DataFrame:
    """For each left record and each series of its entity, the right record nearest in time, if within ``tolerance``.

    ``left``: entity, id, t; ``right``: entity, series, id, t (other columns are ignored). Entities must be normalised.
    Rows with a null entity, series or id, or without a finite t, are left out. Of two right records at the same
    distance the earlier one is taken, of those at the same time the one with the smaller id. A repeated left or right
    row counts once. A left record without any near record gives no row. ``slice_s`` (more than the tolerance) is the
    length of the pieces that an entity is split into. Result: left_id, right_id, series, distance.
    """
    if not slice_s > tolerance >= 0:
        raise ValueError("slice_s must exceed the tolerance")
    a = left.select("entity", F.lit(None).cast("string").alias("series"), F.col("id").cast("bigint").alias("id"), finite("t").alias("t"), F.lit(True).alias("is_left"))
    b = right.select("entity", F.col("series").cast("string").alias("series"), F.col("id").cast("bigint").alias("id"), finite("t").alias("t"), F.lit(False).alias("is_left"))
    b = b.where("series is not null")
    slot = lambda shift: F.floor((F.col("t") + shift) / slice_s)
    reach = tolerance * 1.001 + 1e-6
    a = a.withColumn("slot", slot(0.0))
    b = b.withColumn("slot", F.explode(F.array_distinct(F.array(slot(-reach), slot(0.0), slot(reach)))))
    both = a.unionByName(b).where("id is not null")  # a filter on entity or t would compute both twice; the merge drops nulls
    lined = both.repartition("entity", "slot").sortWithinPartitions("entity", "slot", "t", "is_left", "id")
    return lined.mapInArrow(_merge(tolerance), SCHEMA)

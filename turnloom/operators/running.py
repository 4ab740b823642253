"""Running aggregates of long groups in two levels.

A plain window over a key that holds a third of all rows sorts them in one task. Here the order is cut into buckets: a
window runs inside each bucket, another one over one row per bucket, and a join brings what lies outside the bucket to
its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Adds running sums (in the order of ``bucket``, then ``order``); the bucket must follow the order. Keys may be null."""
    marked = df.withColumn("_b", bucket)
    for name, value in sums.items():
        marked = marked.withColumn(f"_v_{name}", value)
    per = marked.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_a_{n}") for n in sums])
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    with_inner = marked
    for n in sums:
        with_inner = with_inner.withColumn(f"_i_{n}", F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)))
    on = F.col("_b").eqNullSafe(F.col("_kb"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = with_inner.join(per, on)
    return joined.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_a_{n}")).alias(n) for n in sums])


def extreme(df: DataFrame, keys: list[str], bucket: Column, at: str, value: Column, name: str, forward: bool, strict: bool, least: bool) -> DataFrame:
    """Adds the least or greatest ``value`` among the rows of the keys that lie behind (or before) in ``at``.

    ``at`` is a whole number and ``bucket`` rises with it. ``strict`` leaves rows at the same place out, else they count.
    ``value`` is null on rows that only ask. Keys mustn't be null.
    """
    pick = F.min if least else F.max
    best = F.least if least else F.greatest
    marked = df.withColumn("_b", bucket).withColumn("_v", value)
    # always from the far end up to the row: a frame that grows is kept as it is, one that shrinks is read again for every row
    w = Window.partitionBy(*keys, "_b").orderBy(F.desc(at) if forward else F.asc(at)).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    per = marked.groupBy(*keys, "_b").agg(pick("_v").alias("_t"))
    far = Window.partitionBy(*keys).orderBy(F.desc("_b") if forward else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", pick("_t").over(far).alias("_far"))
    joined = marked.withColumn("_near", pick("_v").over(w)).join(per, [*keys, "_b"])
    return joined.withColumn(name, best("_near", "_far")).select(*df.columns, name)


def neighbour(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str, forward: bool = False) -> DataFrame:
    """Adds ``value`` of the row before (or behind) in the order of ``bucket``, then ``order``; null at the end. Keys mustn't be null.

    Like lag and lead over the keys, but no task sorts more than a bucket: what lies outside comes from one row per bucket.
    """
    marked = df.withColumn("_b", bucket)
    edge = (F.min_by if forward else F.max_by)(F.struct(F.col(value).alias("v")), F.struct(*order))
    per = marked.groupBy(*keys, "_b").agg(edge.alias("_edge"))
    by_bucket = Window.partitionBy(*keys).orderBy(F.desc("_b") if forward else F.asc("_b"))
    per = per.select(*keys, "_b", F.lag("_edge").over(by_bucket).alias("_far"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    near = (F.lead if forward else F.lag)(F.struct(F.col(value).alias("v"))).over(inner)
    joined = marked.withColumn("_near", near).join(per, [*keys, "_b"])
    return joined.select(*df.columns, F.coalesce("_near", "_far")["v"].alias(name))


def placed(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], name: str) -> DataFrame:
    """Adds the place of each row from 1, as row_number over the keys would, in two levels."""
    return running(df, keys, bucket, order, {name: F.lit(1)})

"""Bootstraps over units (sessions, lineages), from additive sums per unit.

The draws come from a hash of (seed, replicate, place), so any engine can repeat them. Units are numbered once; a
replicate of n draws is n hashed numbers, counted per unit, so replicates join a table of sums and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import hash_share


def numbered(units: DataFrame, key: str, groups: list[str] | None = None) -> DataFrame:
    """Adds ``u``, the place of the unit (from 0) within its group, and ``n``, how many there are.

    Numbering sorts a group's units in one task: for units by the million use ``poisson_bootstrap``.
    """
    groups = groups or []
    w = Window.partitionBy(*groups).orderBy(key) if groups else Window.partitionBy(F.lit(0)).orderBy(key)
    everyone = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    return units.withColumn("u", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(everyone))


def draw_hash(seed: int) -> Column:
    """60 bits of sha256 of draw ``i`` of replicate ``b``."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("b"), F.col("i")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def drawn(seed: int) -> Column:
    """Place of draw ``i`` of replicate ``b``: 60 bits of sha256 modulo n."""
    return draw_hash(seed) % F.col("n")


def replicates(units: DataFrame, replicates: int, seed: int, groups: list[str] | None = None) -> DataFrame:
    """How often each unit is drawn in each replicate: (groups, b, u, times), from ``numbered`` units."""
    groups = groups or []
    sizes = units.select(*groups, "n").distinct()
    draws = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return draws.withColumn("u", drawn(seed)).groupBy(*groups, "b", "u").agg(F.count(F.lit(1)).alias("times"))


def bootstrap(units: DataFrame, key: str, sums: list[str], statistic: Column, n: int = 200, seed: int = 20260903, groups: list[str] | None = None) -> DataFrame:
    """The statistic (an expression over the summed ``sums``) in every replicate: (groups, b, value)."""
    groups = groups or []
    placed = numbered(units, key, groups)
    times = replicates(placed, n, seed, groups)
    j = times.join(placed.select(*groups, "u", *sums), [*groups, "u"])
    g = j.groupBy(*groups, "b").agg(*[F.sum(F.col(s) * F.col("times")).alias(s) for s in sums])
    return g.select(*groups, "b", statistic.alias("value"))


def bootstrap_alike(units: DataFrame, key: str, sums: list[str], statistic: Column, n: int, seed: int, groups: list[str], most: int) -> DataFrame:
    """The values of ``bootstrap`` for many groups: draws are hashed once for all and counted once for groups of one size.

    ``most``: no group has more units.
    """
    placed = numbered(units, key, groups)
    most = max(most, 1)
    ids = units.sparkSession.range(n * most).select(F.expr(f"cast(id div {most} as int)").alias("b"), F.expr(f"id % {most}").alias("i"))
    hashed = ids.select("b", "i", draw_hash(seed).alias("_h"))
    draws = hashed.join(placed.select("n").distinct(), F.col("i") < F.col("n")).select("n", "b", (F.col("_h") % F.col("n")).alias("u"))
    times = draws.repartition("n", "u").groupBy("n", "u", "b").agg(F.count(F.lit(1)).alias("times"))
    j = times.join(placed.select(*groups, "n", "u", *sums), ["n", "u"])
    g = j.groupBy(*groups, "b").agg(*[F.sum(F.col(s) * F.col("times")).alias(s) for s in sums])
    return g.select(*groups, "b", statistic.alias("value"))


#: P(Poisson(1) <= k) for k = 0, 1, ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def poisson_bootstrap(units: DataFrame, sums: list[str], statistic: Column, key: str, n: int = 200, seed: int = 20260903, groups: list[str] | None = None) -> DataFrame:
    """Like ``bootstrap``, with a Poisson(1) number of times for each unit and replicate, from a hash of both.

    For many units: nothing is numbered or joined, replicates are summed where the units lie. (groups, b, value).
    """
    groups = groups or []
    each = units.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_u", hash_share(F.lit(seed), "b", key))
    times = sum(((F.col("_u") >= p).cast("int") for p in POISSON), F.lit(0))
    each = each.withColumn("_n", times).where("_n > 0")
    g = each.groupBy(*groups, "b").agg(*[F.sum(F.col(s) * F.col("_n")).alias(s) for s in sums])
    return g.select(*groups, "b", statistic.alias("value"))


def interval(values: DataFrame, groups: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """Percentile interval with linear interpolation; replicates without a value are counted and left out."""
    groups = groups or []
    tail = (1 - confidence) / 2
    g = values.groupBy(*groups).agg(F.percentile("value", tail).alias("lo"), F.percentile("value", 1 - tail).alias("hi"), F.count("value").alias("n_valid"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"))
    return g


def interval_by_index(values: DataFrame, n: int, groups: list[str] | None = None) -> DataFrame:
    """The sorted replicate values at places int(0.025 n) and int(0.975 n), without interpolation."""
    groups = groups or []
    ranked = values.withColumn("_r", F.row_number().over((Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("value")) - 1)
    pick = lambda share: F.max(F.when(F.col("_r") == int(share * n), F.col("value")))
    return ranked.groupBy(*groups).agg(pick(0.025).alias("lo"), pick(0.975).alias("hi"))


def weighted_mean(value: str = "vw", weight: str = "w") -> Column:
    return F.try_divide(F.col(value), F.col(weight))
